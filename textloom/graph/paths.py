"""Shortest paths from every node, closeness, betweenness and strong components of edge tables (src, dst)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .ranks import nodes_of


def links(edges: DataFrame) -> DataFrame:
    """Different (src, dst) without loops and null ends."""
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").select("src", "dst").distinct()


def strong_edges(cells: DataFrame, alpha: float) -> DataFrame:
    """src, dst, weight of the cells (i, j, v) that reach ``alpha``."""
    return cells.where(F.col("v") >= alpha).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("weight"))


def ego(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """The edges between the centres (column node) and the nodes they point to."""
    inside = centres.select("node").unionByName(edges.join(centres.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))).distinct()
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """source, node, distance, paths (their number) from the sources (column node; all by default), level by level.

    A level is one join of the frontier with the edges, an aggregation and an anti
    join; all sources advance together.  ``sources`` may be a sample of the nodes:
    the table has a row for each source and node it reaches.
    """
    one_way = written(links(edges))
    start = nodes_of(edges) if sources is None else sources.select("node").distinct()
    level = written(start.where("node IS NOT NULL").select(F.col("node").alias("source"), "node", F.lit(0).alias("distance"), F.lit(1.0).alias("paths")))
    reached = level
    for step in count(1):
        ahead = level.select("source", F.col("node").alias("src"), "paths").join(one_way, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = written(ahead.join(reached, ["source", "node"], "left_anti").select("source", "node", F.lit(step).alias("distance"), "paths"))
        if level.isEmpty():
            return reached
        reached = written(reached.unionByName(level)) if step % 4 == 0 else reached.unionByName(level)


def closeness(edges: DataFrame, inward: bool = True) -> DataFrame:
    """node, closeness: (reached - 1) / (sum of distances), times (reached - 1) / (n - 1); 0 where nothing is reached.

    ``inward`` counts paths that end at the node, else those that start there.
    """
    nodes = written(nodes_of(edges))
    n = nodes.count()
    side = "node" if inward else "source"
    sums = shortest_paths(edges).where("distance > 0").groupBy(F.col(side).alias("node")).agg(F.count("*").alias("r"), F.sum("distance").alias("d"))
    value = F.col("r") / F.col("d") * F.col("r") / max(n - 1, 1)
    return nodes.join(sums, "node", "left").select("node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """node, betweenness: shares of shortest paths through each node, ends not counted.

    Dependencies go back from the farthest level to the nearest, one join and one
    aggregation a level for all sources at once.  With sampled ``sources`` the sums
    are scaled by nodes per source; normalized divides by (n - 1)(n - 2).
    """
    nodes, one_way = written(nodes_of(edges)), written(links(edges))
    paths = written(shortest_paths(edges, sources))
    n, used = nodes.count(), paths.where("distance = 0").count()
    deepest = paths.agg(F.max("distance")).first()[0] or 0
    share = paths.where("false").select("source", "node", F.lit(0.0).alias("share"))
    below = share
    for step in range(deepest - 1, 0, -1):
        after = paths.where(F.col("distance") == step + 1).join(below, ["source", "node"], "left").select("source", F.col("node").alias("dst"), ((1 + F.coalesce("share", F.lit(0.0))) / F.col("paths")).alias("part"))
        gained = after.join(one_way, "dst").groupBy("source", F.col("src").alias("node")).agg(F.sum("part").alias("part"))
        below = written(paths.where(F.col("distance") == step).join(gained, ["source", "node"]).select("source", "node", (F.col("paths") * F.col("part")).alias("share")))
        share = share.unionByName(below)
    scale = n / max(used, 1) / (max((n - 1) * (n - 2), 1) if normalized else 1)
    sums = share.groupBy("node").agg((F.sum("share") * scale).alias("betweenness"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _spread(edges: DataFrame, colours: DataFrame, a: str, b: str) -> DataFrame:
    """node, colour: the smallest colour that reaches a node along edges a -> b."""
    now, before = colours, None
    while True:
        sent = edges.join(now.withColumnRenamed("node", a), a).select(F.col(b).alias("node"), "colour")
        now = written(now.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")))
        state = now.agg(F.sum(F.col("colour").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return now
        before = state


def _run_ends(left: DataFrame, thin: DataFrame, a: str, b: str) -> DataFrame:
    """node, next, least: for thin nodes (one edge in, one out) the first other node along a -> b, and the smallest node passed.

    Pointers double, so the rounds grow with the logarithm of the longest run; nodes of a ring of thin nodes keep a thin ``next``.
    """
    now = thin.join(left.withColumnRenamed(a, "node"), "node").select("node", F.col(b).alias("next"), F.col("node").alias("least"))
    for _ in range(thin.count().bit_length() + 1):
        now = written(now)
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"))
        if now.join(ahead, "next", "left_semi").isEmpty():
            break
        now = now.join(ahead, "next", "left").select("node", F.coalesce("next2", "next").alias("next"), F.least("least", F.coalesce("least2", "least")).alias("least"))
    return written(now)


def _core(left: DataFrame, alive: DataFrame) -> DataFrame:
    """node, component by forward and backward colouring: what the owner of a spread colour reaches backward inside it is a component."""
    done = alive.where("false").select("node", F.col("node").alias("component"))
    while not alive.isEmpty():
        colours = _spread(left, alive.select("node", F.col("node").alias("colour")), "src", "dst")
        inside = left.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst", "c")
        found = colours.where("node = colour").select("node", F.col("colour").alias("component"))
        edge = found
        while True:
            back = inside.join(edge.select(F.col("node").alias("dst"), F.col("component").alias("c")), ["dst", "c"]).select(F.col("src").alias("node"), F.col("c").alias("component")).distinct()
            edge = written(back.join(found, "node", "left_anti"))
            if edge.isEmpty():
                break
            found = written(found.unionByName(edge))
        done = written(done.unionByName(found))
        alive = written(alive.join(found, "node", "left_anti"))
        left = _between(left, alive)
    return done


def _between(left: DataFrame, alive: DataFrame) -> DataFrame:
    return written(left.join(alive.select(F.col("node").alias("src")), "src", "left_semi").join(alive.select(F.col("node").alias("dst")), "dst", "left_semi"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each strongly connected component.  Integer nodes.

    First the graph is made small.  Nodes without edges in or out are components of their
    own and leave together.  Runs of nodes with one edge in and one out become one edge; they
    belong to the component of its ends if these turn out to be in the same one, else
    each is its own.  Both are repeated until neither finds anything; what is left is coloured.
    """
    left = written(links(edges))
    alive = written(nodes_of(edges).where("node IS NOT NULL"))
    done, runs = alive.where("false").select("node", F.col("node").alias("component")), []
    while True:
        ends = left.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(left.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))).groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        degree = written(alive.join(ends, "node", "left").select("node", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i")))
        loose, thin = degree.where("o = 0 OR i = 0").select("node"), degree.where("o = 1 AND i = 1").select("node")
        if not thin.isEmpty():
            after, before = _run_ends(left, thin, "src", "dst"), _run_ends(left, thin, "dst", "src")
            ring = after.join(thin.select(F.col("node").alias("next")), "next", "left_semi").select("node", F.col("least").alias("component"))
            done = written(done.unionByName(ring))
            run = written(after.join(ring, "node", "left_anti").select("node", F.col("next").alias("dst")).join(before.select("node", F.col("next").alias("src")), "node"))
            runs.append(run)
            alive = degree.where("o != 1 OR i != 1").select("node")
            left = left.unionByName(run.where("src != dst").select("src", "dst")).distinct()
        elif not loose.isEmpty():
            done = written(done.unionByName(loose.select("node", F.col("node").alias("component"))))
            alive = degree.where("o > 0 AND i > 0").select("node")
        else:
            break
        left = _between(left, alive)
    done = written(done.unionByName(_core(left, alive)))
    for run in reversed(runs):
        of = lambda end: done.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))  # noqa: E731,B023
        joined = run.join(of("src"), "src").join(of("dst"), "dst").select("node", F.when(F.col("c_src") == F.col("c_dst"), F.col("c_src")).otherwise(F.col("node")).alias("component"))
        done = written(done.unionByName(joined))
    least = done.groupBy("component").agg(F.min("node").alias("least"))
    return done.join(least, "component").select("node", F.col("least").alias("component"))
