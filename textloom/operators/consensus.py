"""Agreement of repeated clusterings: linkage, order of rows, cophenetic coefficient, and how ambiguous pairs are.

``labels`` has (run, i, label), each row once a run.  Rows with the same labels in every run
are one profile; profiles are compared, not rows, and only those that agree somewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut_in_loop, written
from .hierarchy import co_assignment


def ambiguous_share(labels: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """pac, pairs: the share of pairs that are together in more than ``low`` and fewer than ``high`` of the runs; null without pairs."""
    between = (F.col("together") > low) & (F.col("together") < high)
    return co_assignment(labels).agg((F.sum(F.when(between, F.col("pairs")).otherwise(0)) / F.sum("pairs")).alias("pac"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"))


def _profiles(labels: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows by profile (i, id), profiles (id, n, profile) with the smallest row as id, and the number of runs."""
    rows = written(labels.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("profile")))
    profiles = written(rows.groupBy("profile").agg(F.min("i").alias("id"), F.count("*").alias("n")))
    return rows.join(profiles, "profile").select("i", "id"), profiles.select("id", "n", "profile"), labels.select("run").distinct().count()


def _agreements(profiles: DataFrame) -> DataFrame:
    """a, b (a < b) and together: in how many runs, over all pairs of rows, two profiles agree."""
    places = profiles.select("id", "n", F.explode("profile").alias("x"))
    other = places.select(F.col("id").alias("b"), F.col("n").alias("m"), "x")
    return places.join(other, "x").where("id < b").groupBy(F.col("id").alias("a"), "b").agg(F.sum(F.col("n") * F.col("m")).alias("together"))


def _mutual(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b, together, n, m) of clusters that are each other's nearest; the pair with the smaller ids wins a tie."""
    sized = links.join(sizes.select(F.col("id").alias("a"), "n"), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("m")), "b")
    near = F.struct((-(F.col("together") / (F.col("n") * F.col("m")))).alias("far"), "a", "b", "together", "n", "m")
    ends = sized.select(near.alias("near"), F.explode(F.array("a", "b")).alias("id"))
    chosen = ends.groupBy("id").agg(F.min("near").alias("near"))
    return chosen.groupBy("near.a", "near.b", "near.together", "near.n", "near.m").agg(F.count("*").alias("votes")).where("votes = 2").drop("votes")


def average_linkage(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merges (a, b, height, n, m) and order (i, place) of the rows by average linkage of 1 - agreement.

    A cluster is named by its smallest row.  A round merges all pairs of clusters that are each
    other's nearest at once, which average linkage allows as a merge brings no cluster nearer
    than the merged ones were; agreements are whole numbers, so sums do not depend on their
    order.  Profiles of no agreement with what they could join stay apart (their height would be
    1); the order names them by their smallest row.  place runs from 0, children with the
    smaller row first, rows of a profile by i.
    """
    rows, profiles, runs = _profiles(labels)
    links, sizes = written(_agreements(profiles)), profiles.select("id", "n")
    members = profiles.select(F.col("id").alias("profile"), F.col("id").alias("top"), F.lit(0).cast("long").alias("before"))
    merges, turn = None, 0
    while not links.isEmpty():
        pairs = written(_mutual(links, sizes))
        done = pairs.select("a", "b", (1 - F.col("together") / (runs * F.col("n") * F.col("m"))).alias("height"), "n", "m", F.col("together"))
        merges = done if merges is None else merges.unionByName(done)
        moved = pairs.select(F.col("b").alias("id"), F.col("a").alias("into"), "n")

        def renamed(df: DataFrame, name: str) -> DataFrame:
            return df.join(moved.select(F.col("id").alias(name), F.col("into").alias(f"_{name}")), name, "left").withColumn(name, F.coalesce(f"_{name}", name)).drop(f"_{name}")

        ends = renamed(renamed(links, "a"), "b").where("a <> b")
        links = cut_in_loop(turn)(ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("together").alias("together")))
        sizes = cut_in_loop(turn)(renamed(sizes, "id").groupBy("id").agg(F.sum("n").alias("n")))
        step = moved.select(F.col("id").alias("top"), "into", F.col("n").alias("_n"))
        members = cut_in_loop(turn)(members.join(step, "top", "left").select("profile", F.coalesce("into", "top").alias("top"), (F.col("before") + F.coalesce("_n", F.lit(0))).alias("before")))
        turn += 1
    if merges is None:
        merges = _none(profiles)
    return merges, _placed(rows, members, sizes)


def _none(profiles: DataFrame) -> DataFrame:
    empty = profiles.where("false")
    return empty.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("height"), "n", F.col("n").alias("m"), F.col("n").alias("together"))


def _placed(rows: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    from .reports import numbered

    tops = numbered(sizes.select(F.col("id").alias("top"), "n"), "top")
    # rows before a cluster: those of all clusters with smaller numbers, added up by blocks of a thousand
    block = F.col("idx").cast("long") - F.col("idx") % 1000
    sums = tops.groupBy(block.alias("block")).agg(F.sum("n").alias("n")).withColumn("skip", F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", F.coalesce("skip", F.lit(0)).alias("skip"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = tops.withColumn("block", block).withColumn("within", within).join(sums, "block").select("top", (F.col("within") + F.col("skip")).alias("start"))
    profile = members.join(start, "top").select(F.col("profile").alias("id"), (F.col("start") + F.col("before")).alias("at"))
    # rows of a profile are numbered by their place among all rows in (id, i) order, less the profile's first place
    placed = written(numbered(rows, "id", "i"))
    first = placed.groupBy("id").agg(F.min("idx").alias("first"))
    return placed.join(first, "id").join(profile, "id").select("i", (F.col("at") + F.col("idx") - F.col("first")).alias("place"))


def cophenetic(labels: DataFrame, merges: DataFrame) -> DataFrame:
    """cophenetic: the correlation of agreement and merge height over all pairs of rows; null where either is the same for all.

    A merge gives its n * m pairs of rows one height, their mean agreement, so both means are
    equal and the covariance is the variance of heights: no pair of rows is written.
    """
    rows, profiles, runs = _profiles(labels)
    same = profiles.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("double")).alias("same"), F.sum("n").cast("double").alias("all"))
    weight = F.col("n") * F.col("m")
    sized = _agreements(profiles).join(profiles.select(F.col("id").alias("a"), "n"), "a").join(profiles.select(F.col("id").alias("b"), F.col("n").alias("m")), "b")
    squares = lambda df, name: df.agg(F.coalesce(F.sum((F.col("together") / runs) ** 2 / weight), F.lit(0.0)).alias(name))
    total = merges.agg(F.coalesce(F.sum(F.col("together") / runs), F.lit(0.0)).alias("sum"))
    told = same.join(squares(merges, "yy"), F.lit(True)).join(squares(_by_pair(sized), "xx"), F.lit(True)).join(total, F.lit(True))
    pairs = F.col("all") * (F.col("all") - 1) / 2
    spread = lambda name: pairs * (F.col(name) + F.col("same")) - (F.col("sum") + F.col("same")) ** 2
    return told.select(F.when((spread("yy") > 1e-9 * pairs) & (spread("xx") > 1e-9 * pairs), F.sqrt(spread("yy") / spread("xx"))).alias("cophenetic"))


def _by_pair(sized: DataFrame) -> DataFrame:
    return sized.select("together", "n", "m")
