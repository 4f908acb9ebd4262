"""Strings compared by their longest common subsequence: similarities, joins and groups that lose no pair.

The Indel distance of two strings is how many characters have to be deleted and inserted
to turn one into the other: both lengths less twice the longest common subsequence; as
a share of both lengths it is 0 for equal strings and 1 for strings without a common
character.

Candidates meet under q-grams.  A change of one character touches q of them at most, so
strings within a distance share so many that their rarest ones - a prefix of all, in
order of document frequency - cannot all differ.  The longest q (3, 2, 1) for which a
string of that length must share one is taken; with q = 1 there always is one.  Hence
no similar pair is lost, whatever the threshold.  Strings that are null, empty, or
shorter than the least length meet nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..graph.components import connected_components
from ..shared import written

GRAMS = (3, 2, 1)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is one number, its bits the places where the row grows."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, null if one is null."""
    return _common(a, b)


def indel_distance(a: Column, b: Column) -> Column:
    """Normalized Indel distance, 0 for two empty strings."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 0.0).otherwise(1 - 2 * _common(a, b) / both)


def word_similarity(a: Column, b: Column, least: float = 0.75) -> Column:
    """Longest common subsequence over the longer length; 0 under ``least`` and for empty strings."""
    share = _common(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(share >= least, share).otherwise(0.0)


def _kept(n: Column, q: int, threshold: float) -> Column:
    """q-grams that a string of length n shares with every string within the threshold (0 or less: perhaps none)."""
    if q == 1:
        return F.ceil(n * (1 - threshold) / (1 + threshold) - 1e-9)
    return n - q + 1 - q * F.floor(2 * threshold * n / (1 - threshold) + 1e-9)


def _q(n: Column, threshold: float) -> Column:
    out = F.lit(GRAMS[-1])
    for q in GRAMS[-2::-1]:
        out = F.when(_kept(n, q, threshold) >= 1, F.lit(q)).otherwise(out)
    return out


def _grams(values: DataFrame, threshold: float) -> DataFrame:
    """value, n, q, gram for all strings: counted q-grams of each q that the string or one of a similar length is compared by."""
    n = F.length("value")
    near = F.sequence(F.ceil(n * (1 - threshold) / (1 + threshold) - 1e-9).cast("int"), F.floor(n * (1 + threshold) / (1 - threshold) + 1e-9).cast("int"))

    def part(q: int) -> DataFrame:
        used = F.exists(near, lambda m: _q(m, threshold) == q)
        grams = F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(F.col("value"), i, F.lit(q)))
        return values.where(n >= q).where(used).select("value", n.alias("n"), F.lit(q).alias("q"), grams.alias("grams"))

    parts = [part(q) for q in GRAMS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # the k-th occurrence of a gram is a token of its own
    counted = F.flatten(F.transform(F.array_distinct("grams"), lambda g: F.transform(F.sequence(F.lit(1), F.size(F.filter("grams", lambda x: x == g))), lambda k: F.concat_ws(":", k, g))))
    return out.select("value", "n", "q", F.explode(counted).alias("gram"))


def _prefixes(grams: DataFrame, often: DataFrame, threshold: float) -> DataFrame:
    """value, n, q, gram: of each string and q the rarest tokens, so many that one of them must be shared."""
    own = grams.join(often, ["q", "gram"]).groupBy("value", "n", "q").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("tokens"))
    kept = F.lit(0)
    for q in GRAMS:
        kept = F.when(F.col("q") == q, _kept(F.col("n"), q, threshold)).otherwise(kept)
    size = F.size("tokens") - F.greatest(kept, F.lit(1)) + 1
    return own.select("value", "n", "q", F.explode(F.slice("tokens", F.lit(1), F.greatest(size, F.lit(1)).cast("int"))).alias("x")).select("value", "n", "q", "x.gram")


def ratio_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.05, least_length: int = 1) -> DataFrame:
    """a, b, distance: all pairs of different rows' strings (column value) with a normalized Indel distance of at most ``threshold`` (under 1)."""
    if not 0 <= threshold < 1:
        raise ValueError("the threshold is a number from 0 to under 1")
    own = [df.select("value").where(F.length("value") >= max(least_length, 1)).distinct() for df in (left, right)]
    grams = [_grams(v, threshold) for v in own]
    often = grams[0].unionByName(grams[1]).groupBy("q", "gram").agg(F.count("*").alias("df"))
    a, b = (_prefixes(g, often, threshold) for g in grams)
    b = b.select(F.col("value").alias("other"), F.col("n").alias("m"), "q", "gram")
    n, m = F.col("n"), F.col("m")
    fits = F.least(n, m) * 2 >= (1 - threshold) * (n + m) - 1e-9
    met = a.join(b, ["q", "gram"]).where(fits & (F.col("q") == _q(n, threshold))).select(F.col("value").alias("a"), F.col("other").alias("b")).distinct()
    return met.withColumn("distance", indel_distance(F.col("a"), F.col("b"))).where(F.col("distance") <= threshold + 1e-12)


def ratio_join(left: DataFrame, right: DataFrame, on: tuple[str, str], threshold: float = 0.05, least_length: int = 10) -> DataFrame:
    """``left`` with ``match`` and ``distance``: the nearest string of the right side (ties to the smallest), null where none is within the threshold."""
    mine, theirs = (df.select(F.col(c).alias("value")) for df, c in zip((left, right), on, strict=True))
    best = ratio_pairs(mine.where(F.length("value") >= least_length), theirs, threshold).groupBy("a").agg(F.min(F.struct("distance", "b")).alias("best"))
    return left.join(best.select(F.col("a").alias(on[0]), F.col("best.b").alias("match"), F.col("best.distance").alias("distance")), on[0], "left")


def ratio_groups(rows: DataFrame, column: str, threshold: float = 0.05) -> DataFrame:
    """value, group: strings that chains of pairs within the threshold connect share the smallest of them."""
    values = rows.where(F.length(column) >= 1).select(F.col(column).alias("value")).distinct()
    values = written(values.withColumn("node", F.xxhash64("value")))
    of = lambda c: values.select(F.col("value").alias(c), F.col("node").alias(f"node_{c}"))
    pairs = ratio_pairs(values, values, threshold).where("a < b").join(of("a"), "a").join(of("b"), "b")
    groups = connected_components(pairs, "node_a", "node_b")
    named = values.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("value").alias("group"))
    return named.join(least, "component").select("value", "group")


def topic_costs(left: DataFrame, right: DataFrame, least: float = 0.75) -> DataFrame:
    """i, j, cost of topics (topic, word): 1 - mean word similarity over all pairs of their words; topics have few words each."""
    pairs = left.select(F.col("topic").alias("i"), F.col("word").alias("a")).join(F.broadcast(right.select(F.col("topic").alias("j"), F.col("word").alias("b"))), F.lit(True))
    return pairs.groupBy("i", "j").agg((1 - F.avg(word_similarity(F.col("a"), F.col("b"), least))).alias("cost"))


def matched_topics(left: DataFrame, right: DataFrame, rejection: float = 0.4, least: float = 0.75) -> list[tuple]:
    """(i, j, cost) of the assignment of least total cost between two lists of topics, pairs of over ``rejection`` left out."""
    from .ensemble import assign

    costs = topic_costs(left, right, least).toPandas().pivot(index="i", columns="j", values="cost")  # a row for each pair of topics
    turned = len(costs.index) > len(costs.columns)
    table = costs.T if turned else costs
    found = [(table.index[r], table.columns[c], float(table.iat[r, c])) for r, c in enumerate(assign(table.to_numpy()))]
    return sorted((j, i, d) if turned else (i, j, d) for i, j, d in found if d <= rejection)
