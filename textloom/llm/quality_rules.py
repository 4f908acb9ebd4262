"""Quality rules whose cutoffs keep the share of good documents they reject under control.

Each rule compares one number of a document with a cutoff; a document goes if any rule
rejects it.  Cutoffs are learned for each stratum (language) from labelled good
documents, which are dealt into two halves by the hash of their doc_id:

* one half gives the levels, from mild to strict: at level s each rule's cutoff is the
  smallest that at most the share s / (number of rules) of these documents exceed;
* on the other half, a level is tested against the hypothesis "its rules together
  reject more than ``risk`` of the good documents of this stratum" with the exact
  binomial tail.  A stratum's levels are tested from mild to strict and testing stops
  at the first that fails.  Strata share the error level equally, and a stratum whose
  last level is certified hands its part on to the others (a Bonferroni-based
  graphical procedure), so that with probability 1 - ``error`` no level in use rejects
  more than ``risk`` of the good documents of its stratum.

A stratum without a certified level has no learned cutoffs; so have strata whose
labelled documents could not certify a level at the whole ``error``.

Everything is DataFrame expressions, over any number of strata and bins; the driver sees
how many strata there are and how many are certified to the last level.  Cutoffs are
broadcast: a row for each stratum, which has ``least_tested`` labelled documents or more.

Null texts have no words.  Null languages are a stratum of their own.  A doc_id with
labels of both kinds counts as good.  Rows are kept as they come.
"""

from __future__ import annotations

from math import exp, floor, lgamma, log, log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.reports import numbered
from ..shared import stage_folder
from .common import checkpointed, fold

#: Words, and the share of words in repeated windows (percent), at which the base rule rejects.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Rules: name, and the value that is compared with a cutoff.
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1)"),
    ("bars", "n_bars / greatest(n_words, 1)"),
    ("capitals", "n_capitals / greatest(word_chars, 1)"),
    ("shouts", "n_shouts / greatest(n_words, 1)"),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)"),
    ("repeated_words", "n_repeat_words / greatest(n_words, 1)"),
)
#: Values are compared in bins, so many to one; the cutoff that no bin exceeds.
BINS, NO_CUT = 200, (1 << 63) - 1
#: Levels, from mild to strict.
LEVELS = (0.0, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.012, 0.016, 0.024, 0.032, 0.05)
RISK, ERROR, HALVES = 0.01, 0.05, 2


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, and the counts that rules use, one row per document; with ``carry`` the whole row as struct ``row``."""
    kept = ["row"] if carry else []
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"), *whole)
    rows = rows.withColumn("words", words).withColumn("lines", lines)
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), r"[#*$%&|<>]").alias("n_symbols"),
        count_of(F.col("text"), r"\|").alias("n_bars"),
        count_of(F.col("text"), "!").alias("n_shouts"),
        count_of(F.col("text"), "[A-Z]").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        *kept,
    )
    # Only texts with a repeated window need to know where these stand.
    twice = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("placed", placed).drop("windows")
    n = F.size("placed")
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    beside = F.zip_with("placed", F.concat(F.array(none), F.slice("placed", 1, n - 1)), lambda a, b: F.struct(a.alias("a"), (a["h"] == b["h"]).alias("same")))
    after = F.concat(F.slice("placed", 2, n - 1), F.array(none))
    both = F.zip_with(beside, after, lambda a, b: F.when(a["same"] | (a["a"]["h"] == b["h"]), a["a"]["i"]))
    rows = rows.withColumn("starts", F.array_sort(F.filter(both, lambda i: i.isNotNull()))).drop("placed")
    gaps = F.zip_with("starts", F.slice("starts", 2, F.size("starts") - 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")
    # Behind a generator each count is worked out once, however often a later filter names it.
    return rows.select(*kept, F.inline(F.array(F.struct(*(c for c in rows.columns if c not in kept)))))


def bins() -> Column:
    """The bins of all rules' values, in the order of RULES."""
    return F.array(*(F.floor(F.expr(value) * BINS).cast("long") for _, value in RULES))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), to double precision."""
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def certified(rejected: dict[str | None, tuple[int, list[int]]], risk: float, error: float) -> dict[str | None, int]:
    """Index of the strictest certified level of each stratum that has one.

    rejected: good documents of the stratum, and how many of these each level rejects.
    The procedure step by step on a few strata; ``certified_levels`` has its result for tables.
    """
    share, at = {k: error / len(rejected) for k in rejected}, dict.fromkeys(rejected, 0)
    moved = True
    while moved:
        moved = False
        for k in [k for k in rejected if k in share]:
            n, counts = rejected[k]
            while at[k] < len(counts) and binomial_tail(n, counts[at[k]], risk) <= share[k]:
                at[k] += 1
                moved = True
            if at[k] == len(counts):
                freed = share.pop(k)
                share = {other: x + freed / len(share) for other, x in share.items()}
    return {k: i - 1 for k, i in at.items() if i}


def low_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), and 1 for k from the mean on, where it is 1/2 or more."""
    below = F.least(k, F.ceil(n * p)).cast("int")
    start = F.struct((n * log1p(-p)).alias("last"), F.lit(1.0).alias("sum"))  # log of the last term, and the sum in units of it

    def step(x: Column, i: Column) -> Column:
        ratio = (n - i + 1) / i * (p / (1 - p))
        return F.struct((x["last"] + F.log(ratio)).alias("last"), (x["sum"] / ratio + 1).alias("sum"))

    tail = F.aggregate(F.slice(F.sequence(F.lit(0), below), F.lit(2), below), start, step, lambda x: F.exp(x["last"]) * x["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))


def certified_levels(tested: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``tested`` (with n and rejected, of each stratum) with level, the index of its strictest certified one, where it has one.

    Strata without their last level have equal shares of the error at any time, so the
    strata that reach it are those of Holm's procedure: in order of the share they need, each
    finds the error divided by the number of strata not before it.
    """
    if not 0 < error < 0.5:
        raise ValueError("error has to be over 0 and under 0.5")
    tails = tested.withColumn("tails", F.transform("rejected", lambda k: low_tail(F.col("n"), k, risk)))
    # a level needs the share of all levels up to it
    needed = F.transform("tails", lambda _, i: F.array_max(F.slice("tails", F.lit(1), i + 1)))
    strata = checkpointed(tails.withColumn("needed", needed).drop("tails"))
    total = strata.count()
    order = numbered(strata.select(F.element_at("needed", -1).alias("last")), "last")
    reached = order.where(F.col("last") > error / (total - F.col("idx"))).agg(F.min("idx")).first()[0]
    share = 1.0 if reached is None else error / (total - reached)
    level = F.size(F.filter("needed", lambda x: x <= share)) - 1
    return strata.withColumn("level", level).where("level >= 0").drop("needed")


def least_tested(risk: float, error: float) -> int:
    """Good documents without a rejection that certify a level at the whole error."""
    return max(1, floor(log(error) / log1p(-risk)))


def cutoffs(held: DataFrame) -> DataFrame:
    """of (the stratum), cuts: for each rule and level the smallest bin that at most the level's share of the documents exceed."""
    counts = held.select("lang", F.posexplode("bins").alias("rule", "bin")).groupBy("lang", "rule", "bin").agg(F.count("*").alias("n"))
    # a value in bin b takes b / BINS characters, so texts of T bytes have some (2 * BINS * T) ** 0.5 bins
    own = Window.partitionBy("lang", "rule")
    placed = counts.withColumn("over", F.sum("n").over(own.orderBy(F.desc("bin")))).withColumn("total", F.sum("n").over(own))
    cut = lambda level: F.max(F.when(F.col("over") > level / len(RULES) * F.col("total"), F.col("bin")))
    cuts = placed.groupBy("lang", "rule").agg(F.array(*map(cut, LEVELS)).alias("cuts"))
    return cuts.groupBy(F.col("lang").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "cuts"))), lambda x: x["cuts"]).alias("cuts"))


def learn_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """lang, cuts: for each stratum with a certified level, the cutoff bins of RULES; values in a higher bin are rejected."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = measured.join(good, "doc_id", "left_semi").where("NOT " + BASE).select("lang", fold(F.col("doc_id"), HALVES).alias("half"), bins().alias("bins"))
    held = checkpointed(held)
    strata = held.where("half = 0").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least_tested(risk, error))
    none = F.array_repeat(F.array_repeat(F.lit(NO_CUT), len(LEVELS)), len(RULES))
    table = strata.join(cutoffs(held.where("half != 0")), F.col("lang").eqNullSafe(F.col("of")), "left").select("lang", F.coalesce("cuts", none).alias("cuts"))
    table = checkpointed(table)
    # the first level whose cutoff a document exceeds, of any rule
    tested = held.where("half = 0").withColumnRenamed("lang", "own").join(F.broadcast(table), F.col("own").eqNullSafe(F.col("lang")))
    firsts = F.zip_with("bins", "cuts", lambda b, cuts: F.size(F.filter(cuts, lambda c: c >= b)))
    firsts = tested.select("lang", F.array_min(firsts).alias("first"))
    rejected = firsts.groupBy("lang").agg(F.count("*").alias("n"), F.array(*(F.count_if(F.col("first") <= i) for i in range(len(LEVELS)))).alias("rejected"))
    levels = certified_levels(rejected, risk, error).select(F.col("lang").alias("of"), "level")
    return table.join(levels, F.col("lang").eqNullSafe(F.col("of"))).select("lang", F.transform("cuts", lambda c: F.get(c, F.col("level"))).alias("cuts"))


BASE = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"


def verdicts(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with base_failed, rejected_by (rules over their cutoff) and kept."""
    rows = measured.withColumn("base_failed", F.expr(BASE))
    rows = rows.join(F.broadcast(cuts.withColumnRenamed("lang", "of")), F.col("lang").eqNullSafe(F.col("of")), "left")
    over = F.zip_with(bins(), "cuts", lambda b, c: b > c)
    names = F.zip_with(F.array(*(F.lit(name) for name, _ in RULES)), over, lambda name, x: F.when(x, name))
    rows = rows.withColumn("rejected_by", F.array_join(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull()), ",")).drop("of", "cuts")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Counts and verdict of every document."""
    measured = checkpointed(measures(docs))
    return verdicts(measured, learn_cutoffs(measured, labels, risk, error))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that pass.

    Rows are measured once and written with their counts to the shared folder; cutoffs are
    learned from the counts alone, and rows are then judged where they stand, without a join.
    """
    spark = docs.sparkSession
    path = f"{stage_folder(spark)}/measured.parquet"
    measures(docs, carry=True).write.parquet(path)
    measured = spark.read.parquet(path)
    return verdicts(measured, learn_cutoffs(measured, labels, risk, error)).where("kept").select("row.*")
