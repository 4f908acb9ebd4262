"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import remove_written, written


def _stars(edges: DataFrame) -> bool:
    """Does each node have one smaller neighbour, which has none itself, or none at all?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not nodes.where("ups > 1 OR ups = 1 AND least = 0").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", cut=written, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node of each (weakly) connected component.

    Edges with a null end and loops join nothing.  Each round links every node's
    larger neighbours, then its smaller ones, to the smallest node it knows; the
    number of rounds grows with the logarithm of the longest path, and stars around
    their smallest nodes need none.  Only the aggregates of a node's neighbours are
    ever in one place.  Of the tables of ``written`` the last one stays.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = cut(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    pair = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    for _ in range(max_rounds):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        both = now.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.*")
        before, now = now, cut(small.where("u != v").distinct())
        if cut is written:
            remove_written(before)
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")
