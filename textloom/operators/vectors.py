"""Centroids, pruning and exact nearest neighbours of embedding columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroids(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """group, centroid: mean vectors."""
    means = rows.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def centroid_distances(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``rows`` with their distance to the centroid of their group."""
    return rows.join(centroids(rows, group, vector), group).withColumn("distance", distance(F.col(vector).cast("array<double>"), F.col("centroid"))).drop("centroid")


def prune_by_reference(rows: DataFrame, is_reference: Column, deviations: float = 3.0, vector: str = "embedding") -> DataFrame:
    """``rows`` with distance to the reference centroid and kept: within mean + deviations * population deviation of the reference's own."""
    centre = centroids(rows.where(is_reference).withColumn("_all", F.lit(1)), "_all", vector).select("centroid")
    far = rows.withColumn("_reference", is_reference).join(F.broadcast(centre), F.lit(True)).withColumn("distance", distance(F.col(vector).cast("array<double>"), F.col("centroid"))).drop("centroid")
    limit = far.where("_reference").agg((F.avg("distance") + deviations * F.stddev_pop("distance")).alias("_limit"))
    return far.join(F.broadcast(limit), F.lit(True)).withColumn("kept", F.col("distance") <= F.col("_limit")).drop("_limit", "_reference")


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, id, similarity (cosine), place: the k nearest other rows of each query, by similarity to 9 digits, ties by id.

    Queries are taken in blocks of ``block`` vectors; each task keeps its own k best of each
    query.  Null ids and vectors are left out; vectors without length have similarity 0.
    """
    spark = rows.sparkSession
    there = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows, queries = there(rows), there(queries)
    blocks = max(1, -(-queries.count() // block))
    out = spark.createDataFrame([], "query_id long, id long, similarity double")
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        if not own:
            continue
        ids = np.array([r["id"] for r in own], np.int64)
        unit = np.array([r["v"] for r in own], np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, unit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, unit = shared.value
            best, at = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    other = part.column(0).to_numpy()
                    vectors = np.array(part.column(1).to_pylist(), np.float64)
                    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
                    near = np.round(unit @ vectors.T, 9)
                    near[ids[:, None] == other[None]] = -np.inf
                    both, names = np.hstack([best, near]), np.hstack([at, np.broadcast_to(other, near.shape)])
                    order = np.lexsort((names, -both), axis=1)[:, :k]
                    best, at = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
            q, ok = np.repeat(np.arange(len(ids)), best.shape[1]), np.isfinite(best.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[ok]]), pa.array(at.ravel()[ok]), pa.array(best.ravel()[ok])], ["query_id", "id", "similarity"])

        out = out.unionByName(rows.mapInArrow(run, "query_id long, id long, similarity double"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return out.withColumn("place", place).where(F.col("place") <= k)
