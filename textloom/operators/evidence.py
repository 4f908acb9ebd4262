"""Which differences are more than chance: signed-rank tests, the choice of a rank by them, and importances of features by permutation."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .factor import fitted
from .reports import numbered

#: Up to this many differences, without ties and zeros, the tail is counted and not approximated.
EXACT = 50


@functools.cache
def _below(n: int) -> list[int]:
    """How many of the 2^n sets of ranks 1..n have each sum."""
    counts = [1]
    for rank in range(1, n + 1):
        grown = counts + [0] * rank
        for total, c in enumerate(counts):
            grown[total + rank] += c
        counts = grown
    return counts


def tail(n: int, low: float, z: float, exact: bool) -> float:
    """The two-sided p-value of ``low``, the smaller of the two sums of ranks; 1 without differences."""
    if n == 0:
        return 1.0
    if exact:
        return min(1.0, 2 * sum(_below(n)[: int(low) + 1]) / 2**n)
    return math.erfc(abs(z) / math.sqrt(2)) if z is not None and not math.isnan(z) else 1.0


def signed_ranks(pairs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, n, n_zero, w_plus, w_minus, z, p_value of the signed-rank test of the pairs (x, y) of every key.

    Differences of 0 are left out (n_zero counts them), equal ones share the mean of their
    ranks.  Pairs that lack a value, or whose difference is no number, do not count.  Up to
    ``EXACT`` differences without ties and zeros have an exact p-value, others a normal one with
    the variance corrected for ties.  Differences are counted by size before they are numbered
    by ranges, so no task holds a key's pairs.
    """
    keys = list(keys) or ["_all"]
    d = F.col("x").cast("double") - F.col("y").cast("double")
    rows = (pairs.withColumn("_all", F.lit(0)) if keys == ["_all"] else pairs).select(*keys, d.alias("_d")).where("_d IS NOT NULL AND NOT isnan(_d)")
    sizes = rows.groupBy(*keys, F.abs("_d").alias("_size")).agg(F.count("*").alias("_n"), F.sum((F.col("_d") > 0).cast("long")).alias("_up"))
    ranged = written(sizes.repartitionByRange(*keys, "_size").withColumn("_part", F.spark_partition_id()))
    some = ranged.where("_size > 0")
    by_part = some.groupBy(*keys, "_part").agg(F.sum("_n").alias("_skip"))
    earlier = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    skips = by_part.select(*keys, "_part", F.coalesce(F.sum("_skip").over(earlier("_part").partitionBy(*keys)), F.lit(0)).alias("_skip"))
    before = F.coalesce(F.sum("_n").over(earlier("_size").partitionBy(*keys, "_part")), F.lit(0))
    same = functools.reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_part"]))
    ranked = some.withColumn("_before", before).alias("r").join(skips.alias("s"), same).select(*(f"r.{k}" for k in keys), "_n", "_up", (F.col("_skip") + F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank"))
    summed = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"), F.sum((F.col("_n") - F.col("_up")) * F.col("_rank")).alias("w_minus"), F.sum(F.col("_n").cast("double") ** 3 - F.col("_n")).alias("_ties"),
    )
    every = ranged.groupBy(*keys).agg(F.sum(F.when(F.col("_size") == 0, F.col("_n")).otherwise(0)).alias("n_zero"))
    on = functools.reduce(lambda a, b: a & b, (F.col(f"e.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = every.alias("e").join(summed.alias("w"), on, "left").select(
        *(F.col(f"e.{k}") for k in keys), zero("n").alias("n"), "n_zero", zero("w_plus").cast("double").alias("w_plus"), zero("w_minus").cast("double").alias("w_minus"), zero("_ties").alias("_ties"),
    )
    n, low = F.col("n").cast("double"), F.least("w_plus", "w_minus")
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    out = out.withColumn("z", F.when(spread > 0, (low - n * (n + 1) / 4) / F.sqrt(spread)))
    exact = (F.col("n") <= EXACT) & (F.col("n_zero") == 0) & (F.col("_ties") == 0)

    @F.pandas_udf("double")
    def p_value(n: pd.Series, low: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([tail(int(a), b, c, bool(e)) for a, b, c, e in zip(n, low, z, exact)], dtype="float64")

    return out.withColumn("p_value", p_value("n", low, "z", exact)).drop("_ties", *(k for k in keys if k == "_all"))


def rank_by_test(errors: DataFrame, silhouettes: dict[int, float], threshold: float = 0.9, level: float = 0.05) -> tuple[int, dict[int, float]]:
    """The rank chosen among those of ``errors`` (rank, i, error), and the p-value of each rank that was tested.

    If the largest rank is stable (its silhouette reaches the threshold) it is taken.  Otherwise
    ranks are tried upwards: a stable one (above the threshold) whose errors differ from those of
    the rank held so far, by the signed-rank test of errors paired by i, is held instead.  One
    test is one job over two ranks' errors.
    """
    ranks = sorted(silhouettes)
    if not ranks:
        raise ValueError("no ranks")
    held, told = ranks[0], {}
    if len(ranks) == 1 or silhouettes[ranks[-1]] >= threshold:
        return ranks[-1], told
    errors = written(errors.select("rank", "i", "error"))
    of = lambda rank, name: errors.where(F.col("rank") == rank).select("i", F.col("error").alias(name))
    for rank in ranks[1:]:
        if silhouettes[rank] > threshold:
            test = signed_ranks(of(held, "x").join(of(rank, "y"), "i")).first()
            told[rank] = test["p_value"] if test else 1.0
            if told[rank] < level:
                held = rank
    return held, told


def importances(features: DataFrame, known: DataFrame, regressor=None, repeats: int = 3, seed: int = 7) -> DataFrame:
    """feature, importance, deviation: how much the mean squared error grows when a feature's values change places, over ``repeats`` permutations.

    ``features`` has (j, h), one row a j, ``known`` (j, y).  The model of ``transfer`` is fitted once.  A
    permutation puts rows in the order of a hash of j and gives each the values of the next one,
    the last those of the first: one numbering by ranges and one join a permutation serve all features.
    """
    rows = written(features.select("j", "h").join(known.select("j", F.col("y").cast("double").alias("y")).where("y IS NOT NULL"), "j"))
    n = rows.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], "feature int, importance double, deviation double")
    model = fitted(rows.select("j", "h"), rows.select("j", "y"), regressor)
    from pyspark.ml.functions import array_to_vector

    places = F.sequence(F.lit(-1), F.size("h") - 1)  # -1: nothing is changed
    out = None
    for turn in range(repeats):
        at = numbered(rows.withColumn("_hash", F.xxhash64("j", F.lit(seed + turn))), "_hash", "j")
        giver = at.select(F.pmod(F.col("idx") - 1, F.lit(n)).alias("idx"), F.col("h").alias("given"))
        mixed = at.join(giver, "idx").select("y", "h", "given", F.explode(places).alias("feature"))
        vector = F.transform("h", lambda x, k: F.when(k == F.col("feature"), F.try_element_at("given", (k + 1).cast("int"))).otherwise(x))
        guessed = model.transform(mixed.select("y", "feature", array_to_vector(vector).alias("features")))
        error = guessed.groupBy("feature").agg(F.avg((F.col("prediction") - F.col("y")) ** 2).alias("error")).withColumn("turn", F.lit(turn))
        out = error if out is None else out.unionByName(error)
    out = written(out)  # a row per feature and permutation
    base = out.where("feature = -1").select("turn", F.col("error").alias("base"))
    grown = out.where("feature >= 0").join(base, "turn").withColumn("more", F.col("error") - F.col("base"))
    return grown.groupBy("feature").agg(F.avg("more").alias("importance"), F.stddev_pop("more").alias("deviation"))
