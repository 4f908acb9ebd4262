"""Matrices and tensors with known factors, for tests and timings at any size.

Every cell is worked out where it stands: entries of the factors are hashes of mode, place
and component, so nothing is shuffled or broadcast and a seed gives the same cells anywhere.
"""

from __future__ import annotations

from functools import reduce
from math import prod
from operator import add, and_, mul, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ensemble import unit

MODES = ("i", "j", "t")


def entry(mode: int, component: int, seed: int) -> Column:
    """The factor entry of a mode's component at the row's place, uniform in [0, 1)."""
    return unit(F.lit(mode), F.col(MODES[mode]), F.lit(component), F.lit(seed))


def grid(spark: SparkSession, shape: tuple[int, ...], density: float = 1.0, seed: int = 7) -> DataFrame:
    """i, j (and t, for three modes) of all cells, or of each with the chance ``density``; all cells are walked."""
    places = [F.expr(f"(id div {prod(shape[m + 1 :])}L) % {size}").alias(MODES[m]) for m, size in enumerate(shape)]
    cells = spark.range(prod(shape)).select(*places)
    return cells if density >= 1 else cells.where(unit(*(F.col(m) for m in MODES[: len(shape)]), F.lit(seed)) < density)


def planted(cells: DataFrame, rank: int, seed: int = 7) -> DataFrame:
    """``cells`` with v, the sum over components of the product of the modes' entries."""
    modes = [m for m, name in enumerate(MODES) if name in cells.columns]
    return cells.withColumn("v", reduce(add, (reduce(mul, (entry(m, k, seed) for m in modes)) for k in range(rank))))


def planted_relations(cells: DataFrame, rank: int, seed: int = 7) -> DataFrame:
    """``cells`` (i, j, t) with v = a(i) r(t) a(j)', one factor a for both ends of a relation."""

    def end(place: str, component: int) -> Column:
        return unit(F.lit(0), F.col(place), F.lit(component), F.lit(seed))

    parts = [end("i", a) * entry(2, a * rank + b, seed) * end("j", b) for a in range(rank) for b in range(rank)]
    return cells.withColumn("v", reduce(add, parts))


def planted_boolean(cells: DataFrame, rank: int, ones: float = 0.3, seed: int = 7) -> DataFrame:
    """``cells`` (i, j) with v, 1 where some component has a one at both places; an entry is one with the chance ``ones``."""
    both = [and_(entry(0, k, seed) < ones, entry(1, k, seed) < ones) for k in range(rank)]
    return cells.withColumn("v", reduce(or_, both).cast("int"))
