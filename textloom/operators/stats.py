"""Aggregates, attribution, top-k, metrics, merges and duplicate rules on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed


def originator_stats(papers: DataFrame, key: str = "author") -> DataFrame:
    """key, year, paper_count, num_citations, attribution from rows (paper, key, year, citations).

    attribution: mean over papers of 1 / (different keys of the paper).  Null keys are left out.
    """
    rows = papers.where(F.col(key).isNotNull() & F.col("year").isNotNull()).select("paper", key, "year", "citations").distinct()
    share = rows.groupBy("paper").agg((1.0 / F.countDistinct(key)).alias("share"))
    return rows.join(share, "paper").groupBy(key, "year").agg(F.countDistinct("paper").alias("paper_count"), F.sum("citations").alias("num_citations"), F.avg("share").alias("attribution"))


def time_roll_up(stats: DataFrame, key: str = "author") -> DataFrame:
    """Sums over years; attribution weighted by paper_count."""
    weighted = F.sum(F.col("attribution") * F.col("paper_count")) / F.sum("paper_count")
    return stats.groupBy(key).agg(F.sum("paper_count").alias("paper_count"), F.sum("num_citations").alias("num_citations"), weighted.alias("attribution"))


def mode_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the most frequent value of each key, ties to the smallest."""
    counts = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("best"))
    return best.select(key, F.col("best.v").alias(value))


def top_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def group_summary(rows: DataFrame, keys: list[str], sums: list[str], means: list[str], distinct: list[str]) -> DataFrame:
    kept = rows.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    return kept.groupBy(*keys).agg(*(F.sum(c).alias(f"sum_{c}") for c in sums), *(F.avg(c).alias(f"mean_{c}") for c in means), *(F.countDistinct(c).alias(f"n_{c}") for c in distinct))


def confusion_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy, weighted precision, recall and f1, and Matthews correlation of 0/1 columns, from one pass."""
    count = lambda t, g: F.sum(F.when((F.col(truth) == t) & (F.col(guess) == g), 1.0).otherwise(0.0))
    c = rows.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    c = c.withColumn("n", F.expr("tp + fp + fn + tn"))
    safe = "coalesce(({}) / nullif({}, 0), 0)"
    p1, p0, r1, r0 = safe.format("tp", "tp + fp"), safe.format("tn", "tn + fn"), safe.format("tp", "tp + fn"), safe.format("tn", "tn + fp")
    f1, f0 = safe.format("2 * tp", "2 * tp + fp + fn"), safe.format("2 * tn", "2 * tn + fp + fn")
    both = lambda a, b: f"(({a}) * (tp + fn) + ({b}) * (tn + fp)) / n"
    mcc = safe.format("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")
    return c.select(F.expr("(tp + tn) / n").alias("accuracy"), F.expr(both(p1, p0)).alias("precision"), F.expr(both(r1, r0)).alias("recall"), F.expr(both(f1, f0)).alias("f1"), F.expr(mcc).alias("mcc"))


def merge_prefer_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge; shared columns come from the left where it has them.  Null keys match nothing."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    joined = left.alias("l").join(right.alias("r"), key, "full_outer")
    own = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in shared]
    rest = [F.col(f"l.{c}") for c in left.columns if c not in shared and c != key] + [F.col(f"r.{c}") for c in right.columns if c not in shared and c != key]
    return joined.select(key, *own, *rest)


def drop_by_fewest_nulls(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of a key the one with the fewest nulls (ties by ``order``); rows without key stay."""
    nulls = sum((F.col(c).isNull().cast("int") for c in rows.columns), F.lit(0))
    best = rows.where(F.col(key).isNotNull()).withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(nulls, *order))).where("_place = 1").drop("_place")
    return best.unionByName(rows.where(F.col(key).isNull()))


def drop_conflicts(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Different (key, values) rows of the keys that have one such row only; null keys are kept."""
    different = rows.select(key, *values).distinct()
    single = different.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return different.join(single, key, "left_semi").unionByName(different.where(F.col(key).isNull()))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` put in place of those of the same key."""
    return table.join(changes, key, "left_anti").unionByName(changes)


def uniqueness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_different: a row per column."""
    counts = rows.agg(*(F.countDistinct(c).alias(c) for c in columns))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_different")) for c in columns))))


def citation_hops(references: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """paper, hop: papers reached from the seeds (column paper) in so many citations, at their smallest hop."""
    edge = checkpointed(seeds.select("paper").distinct().withColumn("hop", F.lit(0)))
    reached = edge
    for h in range(1, hops + 1):
        edge = checkpointed(edge.select("paper").join(references, "paper").select(F.col("cited").alias("paper")).distinct().join(reached, "paper", "left_anti").withColumn("hop", F.lit(h)))
        reached = reached.unionByName(edge)
    return reached
