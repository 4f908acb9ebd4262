"""Degrees, PageRank and HITS on edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def nodes_of(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    return edges.select(*by, F.col("src").alias("node")).unionByName(edges.select(*by, F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """node, in_degree, out_degree, degree, in_weight, out_weight; in each graph that the columns ``by`` part off."""
    ends = edges.select(*by, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0.0).alias("iw"))
    ends = ends.unionByName(edges.select(*by, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("ow"), F.col("weight").alias("iw")))
    out = ends.groupBy(*by, "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("iw").alias("in_weight"), F.sum("ow").alias("out_weight"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, by: list[str] = ()) -> DataFrame:
    """node, rank: weighted, dangling mass spread over all nodes; stops when ranks change by less than n * tolerance in sum.

    ``by``: columns that part the edges into graphs of their own, all ranked together.
    Ranks of a graph sum to 1, so what nodes without edges out lose is what the others do not pass on.
    """
    by = list(by)
    nodes = written(nodes_of(edges, by))
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    total = edges.groupBy(*by, "src").agg(F.sum("weight").alias("total"))
    share = written(edges.join(total, [*by, "src"]).select(*by, "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    whole = lambda df: F.broadcast(df) if not by else df  # noqa: E731  (one row without by)
    nodes = written(nodes.join(sizes, by) if by else nodes.join(whole(sizes), F.lit(True)))
    ranks = nodes.select(*by, "node", (1.0 / F.col("n")).alias("rank"))
    for _ in range(rounds):
        got = share.join(ranks.withColumnRenamed("node", "src"), [*by, "src"]).groupBy(*by, F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        passed = got.groupBy(*by).agg(F.sum("got").alias("passed"))
        new = nodes.join(got, [*by, "node"], "left").join(ranks, [*by, "node"])
        new = new.join(passed, by, "left") if by else new.join(whole(passed), F.lit(True))
        mass = F.coalesce("got", F.lit(0.0)) + (1 - F.coalesce("passed", F.lit(0.0))) / F.col("n")
        new = written(new.select(*by, "node", (alpha * mass + (1 - alpha) / F.col("n")).alias("new"), "rank", "n"))
        if tolerance:
            moved = new.groupBy(*by, "n").agg(F.sum(F.abs(F.col("new") - F.col("rank"))).alias("d")).where(F.col("d") >= F.col("n") * tolerance)
            if moved.isEmpty():
                return new.select(*by, "node", F.col("new").alias("rank"))
        ranks = new.select(*by, "node", F.col("new").alias("rank"))
    return ranks


def hits(edges: DataFrame, rounds: int = 100, tolerance: float = 0.0) -> DataFrame:
    """node, hub, authority, each summing to 1, after so many rounds or when hubs change by less than the tolerance in sum.

    A single node has 1 for both; in a graph without weights all are 0.
    """
    nodes = written(nodes_of(edges))
    n = nodes.count()
    if n < 2 or not (edges.agg(F.sum("weight")).first()[0] or 0):
        return nodes.select("node", F.lit(float(n == 1)).alias("hub"), F.lit(float(n == 1)).alias("authority"))
    hubs = nodes.withColumn("hub", F.lit(1.0 / n))
    authorities = None
    for _ in range(rounds):
        authorities = edges.join(hubs.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.sum(F.col("hub") * F.col("weight")).alias("a")).withColumnRenamed("dst", "node")
        authorities = written(authorities.join(F.broadcast(authorities.agg(F.sum("a").alias("s"))), F.lit(True)).select("node", (F.col("a") / F.col("s")).alias("authority")))
        new = edges.join(authorities.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.sum(F.col("authority") * F.col("weight")).alias("h")).withColumnRenamed("src", "node")
        new = written(new.join(F.broadcast(new.agg(F.sum("h").alias("s"))), F.lit(True)).select("node", (F.col("h") / F.col("s")).alias("hub")))
        moved = new.join(hubs.withColumnRenamed("hub", "old"), "node", "full_outer").agg(F.sum(F.abs(F.coalesce("hub", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] if tolerance else None
        hubs = new
        if tolerance and moved < tolerance:
            break
    out = nodes.join(hubs, "node", "left").join(authorities, "node", "left")
    return out.select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def stat_table(edges: DataFrame, attributes: DataFrame | None = None, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """degrees, rank, hub and authority of each node beside its attributes (column node); nodes without attributes have null ones."""
    out = degrees(edges).join(pagerank(edges, rounds=rounds, tolerance=tolerance), "node").join(hits(edges, rounds, tolerance), "node")
    return out if attributes is None else out.join(attributes, "node", "left")


def component_sizes(components: DataFrame) -> DataFrame:
    """node, component, size, place: components numbered from 1 by size, ties by their smallest node."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    from ..operators.reports import numbered

    order = numbered(sizes.select("component", "size", "least", (-F.col("size")).alias("_less")), "_less", "least").select("component", "size", (F.col("idx") + 1).alias("place"))
    return components.join(order, "component").select("node", "component", "size", "place")


def community_edges(cells: DataFrame, members: DataFrame) -> DataFrame:
    """community, slice, src, dst, weight of the cells (i, j, slice, v) whose ends are both members (community, node)."""
    ends = members.select("community", "node").distinct()
    left = cells.join(ends.withColumnRenamed("node", "i"), "i")
    both = left.join(ends.withColumnRenamed("node", "j"), ["community", "j"])
    return both.select("community", "slice", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("weight"))


def node_attributes(lines: DataFrame) -> DataFrame:
    """author, affiliation, country of the affiliation with most papers of an author, ties by name; rows as paper, author, affiliation, country."""
    papers = lines.where("affiliation IS NOT NULL").groupBy("author", "affiliation", "country").agg(F.countDistinct("paper").alias("n"))
    best = papers.groupBy("author").agg(F.min(F.struct((-F.col("n")).alias("n"), "affiliation", "country")).alias("b"))
    return best.select("author", "b.affiliation", "b.country")
