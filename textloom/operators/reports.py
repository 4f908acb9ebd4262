"""Tables about papers, authors, affiliations, funders and clusters.

``lines`` has one row per paper and author: paper, author, affiliation, country, and what
else is named below.  Rows may repeat; each paper counts once for each key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_tokens
from ..graph.components import connected_components
from ..shared import checkpointed, written
from .stats import mode_map
from .text import postings


def merge_tables(left: DataFrame, right: DataFrame, key: str, lower_key: bool = True, keep_null_keys: bool = True, required: list[str] = ()) -> DataFrame:
    """Full outer merge that prefers the left; keys in lower case, rows without a ``required`` column dropped, repeated rows once.

    Null keys match nothing; they stay as rows of their own unless ``keep_null_keys`` is false.
    """
    lowered = lambda df: df.withColumn(key, F.lower(F.col(key))) if lower_key else df
    left, right = lowered(left), lowered(right)
    if not keep_null_keys:
        left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    joined = left.alias("l").join(right.alias("r"), key, "full_outer")
    side = lambda c: [F.col(f"{t}.{c}") for t, df in (("l", left), ("r", right)) if c in df.columns]
    out = joined.select(key, *(F.coalesce(*side(c)).alias(c) for c in names)).distinct()
    return out.where(reduce(lambda a, c: a & F.col(c).isNotNull(), required, F.lit(True)))


def tagged_union(tables: dict[str, DataFrame], column: str = "origin") -> DataFrame:
    """The rows of all tables with the name of their own; columns that one lacks are null."""
    named = [df.withColumn(column, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def hop_candidates(references: DataFrame, frontier: DataFrame, seen: DataFrame, most: int | None = None) -> DataFrame:
    """paper, times: papers that the frontier cites and that were not seen, the most often cited first (ties by paper)."""
    cited = references.join(frontier.select("paper"), "paper", "left_semi").groupBy(F.col("cited").alias("paper")).agg(F.count("*").alias("times"))
    new = cited.join(seen.select("paper"), "paper", "left_anti")
    return new if most is None else new.orderBy(F.desc("times"), "paper").limit(most)


def hop_size(references: DataFrame, seen: DataFrame) -> DataFrame:
    """n_seen, n_new, n_total: papers before and after a hop over all references of the seen ones."""
    new = hop_candidates(references, seen, seen)
    both = seen.select("paper").distinct().select(F.lit(1).alias("old")).unionByName(new.select(F.lit(0).alias("old")))
    return both.agg(F.coalesce(F.sum("old"), F.lit(0)).alias("n_seen"), F.coalesce(F.sum(1 - F.col("old")), F.lit(0)).alias("n_new"), F.count("*").alias("n_total"))


def suggestions(lines: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value, n_papers of the values a filter can take."""
    pairs = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))
    rows = lines.select("paper", F.explode(pairs).alias("x")).select("paper", "x.*").where("value IS NOT NULL")
    return rows.groupBy("kind", "value").agg(F.countDistinct("paper").alias("n_papers"))


def author_table(lines: DataFrame) -> DataFrame:
    """author, n_papers, first_year, last_year, n_affiliations, n_collaborators; years of 0 or null do not count."""
    own = lines.where("author IS NOT NULL").select("paper", "author", "affiliation", F.when(F.col("year") > 0, F.col("year")).alias("year"))
    table = own.groupBy("author").agg(F.countDistinct("paper").alias("n_papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("affiliation").alias("n_affiliations"))
    pairs = own.select("paper", "author").distinct()
    others = pairs.join(pairs.withColumnRenamed("author", "other"), "paper").where("author != other").select("author", "other").distinct()
    return table.join(others.groupBy("author").agg(F.count("*").alias("n_collaborators")), "author", "left").withColumn("n_collaborators", F.coalesce("n_collaborators", F.lit(0)))


def apply_ids(papers: DataFrame, ids: DataFrame, column: str = "author_ids") -> DataFrame:
    """paper, ids: the ``;`` list of a paper with ids replaced by those of the map (old, new), in their order; unknown ones go, repeated ones stay once."""
    at = papers.select("paper", F.posexplode(F.split(column, ";")).alias("pos", "x")).select("paper", "pos", F.trim("x").alias("old"))
    mapped = at.join(ids, "old").groupBy("paper", "new").agg(F.min("pos").alias("pos"))
    listed = mapped.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("all"))  # the authors of one paper
    return papers.select("paper").join(listed, "paper", "left").select("paper", F.array_join(F.transform("all", lambda a: a["new"]), ";").alias("ids"))


def author_lines(papers: DataFrame, author_ids: str = "author_ids", names: str = "authors") -> DataFrame:
    """paper, pos, author_id, author, affiliation_id, affiliation, country: a row for each author of a paper and affiliation (or none)."""
    clean = lambda c: F.transform(F.split(c, ";"), lambda x: F.trim(x))
    both = F.arrays_zip(clean(author_ids).alias("author_id"), clean(names).alias("author"))
    rows = papers.select("paper", "affiliations", F.posexplode(both).alias("pos", "a")).select("paper", "pos", "a.author_id", "a.author", "affiliations").where("author_id != ''")
    own = F.filter("affiliations", lambda f: F.array_contains(f["authors"], F.col("author_id")))
    rows = rows.select("paper", "pos", "author_id", "author", F.explode_outer(own).alias("f"))
    return rows.select("paper", "pos", "author_id", "author", F.col("f.id").alias("affiliation_id"), F.col("f.name").alias("affiliation"), F.col("f.country").alias("country"))


def near_strings(left: DataFrame, right: DataFrame, distance: int = 1) -> DataFrame:
    """a, b, d of strings (column value) within an edit distance of 1 or 2, met under what they are after so many deletions."""

    def shorter(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))

    def keys(c: Column) -> Column:
        out = F.array_append(shorter(c), c)
        for _ in range(distance - 1):
            out = F.concat(out, F.flatten(F.transform(out, shorter)))
        return F.array_distinct(out)

    of = lambda df, name: df.select("value").distinct().select(F.col("value").alias(name), F.explode(keys(F.col("value"))).alias("key"))
    met = of(left, "a").join(of(right, "b"), "key").select("a", "b").distinct().withColumn("d", F.levenshtein("a", "b"))
    return met.where(F.col("d") <= distance)


def fuzzy_join(left: DataFrame, right: DataFrame, on: tuple[str, str], distance: int = 1, least_length: int = 5) -> DataFrame:
    """``left`` with ``match`` and ``d``: the nearest string of the right side (ties to the smallest), null where none is near."""
    mine, theirs = (df.where(F.length(c) >= least_length).select(F.col(c).alias("value")) for df, c in zip((left, right), on, strict=True))
    best = near_strings(mine, theirs, distance).groupBy("a").agg(F.min(F.struct("d", "b")).alias("best"))
    return left.join(best.select(F.col("a").alias(on[0]), F.col("best.b").alias("match"), F.col("best.d").alias("d")), on[0], "left")


def fuzzy_groups(rows: DataFrame, column: str, distance: int = 1) -> DataFrame:
    """value, group: strings that chains of near ones connect share the smallest of them."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    values = checkpointed(values.withColumn("node", F.xxhash64("value")))
    of = lambda c: values.select(F.col("value").alias(c), F.col("node").alias(f"node_{c}"))
    pairs = near_strings(values, values, distance).where("a < b").join(of("a"), "a").join(of("b"), "b")
    groups = connected_components(pairs, "node_a", "node_b", checkpointed)
    named = values.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("value").alias("group"))
    return named.join(least, "component").select("value", "group")


def funder_table(funding: DataFrame) -> DataFrame:
    """funder, country, year, paper_count, num_citations, attribution from rows (paper, funder, country, year, citations).

    Names of one country that differ in case, punctuation or one letter are one funder, by its
    most frequent name.  attribution: mean over papers of 1 / (different funders of the paper).
    """
    key = F.trim(F.regexp_replace(F.lower("funder"), r"[^\p{L}\p{N}]+", " "))
    rows = funding.where("funder IS NOT NULL").withColumn("full", F.concat_ws("|", F.coalesce("country", F.lit("")), key))
    merged = checkpointed(rows.join(fuzzy_groups(rows, "full").withColumnRenamed("value", "full"), "full"))
    rows = merged.drop("funder").join(mode_map(merged, "group", "funder"), "group").select("paper", "group", "funder", "country", "year", "citations").distinct()
    share = rows.groupBy("paper").agg((1.0 / F.countDistinct("group")).alias("share"))
    by = rows.join(share, "paper").groupBy("group", "funder", "country", "year")
    return by.agg(F.countDistinct("paper").alias("paper_count"), F.sum("citations").alias("num_citations"), F.avg("share").alias("attribution")).drop("group")


def place_counts(lines: DataFrame) -> DataFrame:
    """affiliation, country (the most frequent one), n_papers, n_authors."""
    by = lines.where("affiliation IS NOT NULL").groupBy("affiliation").agg(F.countDistinct("paper").alias("n_papers"), F.countDistinct("author").alias("n_authors"))
    return by.join(mode_map(lines, "affiliation", "country"), "affiliation", "left")


def cluster_table(lines: DataFrame) -> DataFrame:
    """cluster, n_papers, n_core (type 0), n_authors, n_affiliations, n_countries, citations (once a paper), from rows with cluster, type and citations."""
    papers = lines.select("cluster", "paper", "type", "citations").distinct()
    sums = papers.groupBy("cluster").agg(F.count("*").alias("n_papers"), F.sum((F.col("type") == 0).cast("long")).alias("n_core"), F.sum("citations").alias("citations"))
    names = lines.groupBy("cluster").agg(F.countDistinct("author").alias("n_authors"), F.countDistinct("affiliation").alias("n_affiliations"), F.countDistinct("country").alias("n_countries"))
    return sums.join(names, "cluster")


def type_summary(lines: DataFrame) -> DataFrame:
    """type, n_papers, n_authors, n_affiliations, n_countries."""
    return lines.groupBy("type").agg(*(F.countDistinct(c).alias(n) for c, n in (("paper", "n_papers"), ("author", "n_authors"), ("affiliation", "n_affiliations"), ("country", "n_countries"))))


def top_in_cluster(lines: DataFrame, key: str, n: int, group: str = "cluster") -> DataFrame:
    """group, key, n_papers, citations, place: the first n keys of each group by citations, then papers, then key; papers count once."""
    once = lines.where(F.col(key).isNotNull()).select(group, key, "paper", "citations").distinct()
    sums = once.groupBy(group, key).agg(F.count("*").alias("n_papers"), F.sum("citations").alias("citations"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("citations"), F.desc("n_papers"), key))
    return sums.withColumn("place", place).where(F.col("place") <= n)


def hyphen_grams(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gram, tf, df of runs of tokens that have exactly n parts when hyphens part words too."""
    words = lower_tokens(F.col(text_col))
    found = []
    for k in range(1, n + 1):
        runs = words
        for j in range(1, k):
            runs = F.zip_with(runs, F.slice(words, j + 1, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        found.append(F.filter(runs, lambda g: g.isNotNull() & (F.size(F.filter(F.split(g, "[ -]"), lambda p: p != "")) == n)))
    per_doc = docs.select(id_col, F.explode(F.concat(*found)).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("n"))
    return per_doc.groupBy("gram").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def term_weights(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, tf, df, weight: mean over all documents of tf * (ln((1 + n) / (1 + df)) + 1), without norms."""
    n = docs.count()
    own = postings(docs, id_col, text_col).where(F.col("token").isin([t.lower() for t in terms]))
    by = own.groupBy(F.col("token").alias("term")).agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    return by.withColumn("weight", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0) / n)


def merge_counts(rows: DataFrame, column: str) -> DataFrame:
    """key, n: sums over maps of counts."""
    return rows.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def assign_clusters(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` with cluster (the first place of the largest value) and share (that value to the sum of absolute ones)."""
    c = F.col(vector)
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.abs(x))
    return rows.withColumn("cluster", F.array_position(c, F.array_max(c)) - 1).withColumn("share", F.array_max(c) / total)


def cluster_sizes(rows: DataFrame) -> DataFrame:
    """cluster, n, percent, mean_share."""
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("share").alias("mean_share"))
    total = rows.agg(F.count("*").alias("total"))
    return sizes.join(F.broadcast(total), F.lit(True)).select("cluster", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"), "mean_share")


def correlations(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """i, j, r for i < j: Pearson correlations of the places of a vector column; null vectors are left out."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    whole = rows.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    matrix = Correlation.corr(whole, "v").first()[0].toArray()  # places times places numbers
    pairs = [(i, j, float(matrix[i, j])) for j in range(len(matrix)) for i in range(j)]
    return rows.sparkSession.createDataFrame(pairs, "i int, j int, r double")


def top_unknown(scores: DataFrame, known: DataFrame, n: int, row: str = "row", column: str = "col") -> DataFrame:
    """row, col, score, place: the n highest scores of cells that are not known, ties by column."""
    new = scores.join(known.select(row, column).distinct(), [row, column], "left_anti")
    place = F.row_number().over(Window.partitionBy(row).orderBy(F.desc("score"), column))
    return new.withColumn("place", place).where(F.col("place") <= n)


def predicted(left: DataFrame, right: DataFrame, row_bias: DataFrame | None = None, col_bias: DataFrame | None = None, mean: float = 0.0) -> DataFrame:
    """row, col, score: products of factors (row, k, w) and (k, col, h) with biases (row or col, b) and a mean."""
    out = left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("h")).alias("score"))
    for side, bias in (("row", row_bias), ("col", col_bias)):
        if bias is not None:
            out = out.join(bias, side, "left").withColumn("score", F.col("score") + F.coalesce("b", F.lit(0.0))).drop("b")
    return out.withColumn("score", F.col("score") + mean)


def top_predicted(left: DataFrame, right: DataFrame, known: DataFrame, n: int, col_bias: DataFrame | None = None, mean: float = 0.0) -> DataFrame:
    """``top_unknown`` of ``predicted``: row, col, score, place, without a score for every row and column.

    Rows with the same factors (k, w) are one profile, whose columns are scored and put in
    order once.  A row's n best unknown columns stand among the first n + s of its profile, of
    which it knows s, so a profile's list ends at n and the most that a row knows.  Work grows
    with profiles times columns; where all rows differ it is that of all pairs.  ``known`` is
    read twice.
    """
    rows = left.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("profile"))
    profiles = written(rows.select("profile").distinct().withColumn("id", F.monotonically_increasing_id()))
    owners = rows.join(profiles, "profile").select("row", "id")
    most = known.where("row IS NOT NULL").groupBy("row").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    scores = predicted(profiles.select(F.col("id").alias("row"), F.inline("profile")), right, col_bias=col_bias, mean=mean)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "col"))
    listed = written(scores.withColumn("place", place).where(F.col("place") <= n + most).select(F.col("row").alias("id"), "col", "score", "place"))
    met = known.join(listed.select("col").distinct(), "col").join(owners, "row").join(listed, ["id", "col"])
    taken = met.groupBy("row").agg(F.collect_set("place").alias("taken"))
    free = F.when(F.col("taken").isNull(), F.sequence(F.lit(1), F.lit(n))).otherwise(F.slice(F.array_except(F.sequence(F.lit(1), F.size("taken") + n), F.col("taken")), 1, n))
    wanted = owners.join(taken, "row", "left").select("row", "id", F.posexplode(free).alias("at", "place"))
    return wanted.join(listed, ["id", "place"]).select("row", "col", "score", (F.col("at") + 1).alias("place"))


def divergence(x: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """kl: sum over all cells of x ln(x / y) - x + y, y = w h; error: ‖x - y‖ / ‖x‖.

    x: row, col, v without zeros; w: row, k, w; h: k, col, h.  Sums over cells without x come
    from sums and products of the factors, so zeros are never made.
    """
    y = x.join(w, "row").join(h, ["k", "col"]).groupBy("row", "col").agg(F.first("v").alias("v"), F.sum(F.col("w") * F.col("h")).alias("y"))
    y = x.select("row", "col", "v").join(y.drop("v"), ["row", "col"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    own = y.agg(F.sum(F.expr("CASE WHEN y > 0 THEN v * ln(v / y) ELSE CAST('Infinity' AS DOUBLE) END - v")).alias("kl"), F.sum(F.col("v") * F.col("y")).alias("vy"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    sums = w.groupBy("k").agg(F.sum("w").alias("w")).join(h.groupBy("k").agg(F.sum("h").alias("h")), "k").agg(F.sum(F.col("w") * F.col("h")).alias("y"))
    gram = lambda df, at, v: df.alias("a").join(df.alias("b"), at).groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("l")).agg(F.sum(F.col(f"a.{v}") * F.col(f"b.{v}")).alias(v))
    yy = gram(w, "row", "w").join(gram(h, "col", "h"), ["k", "l"]).agg(F.sum(F.col("w") * F.col("h")).alias("yy"))
    all_ = own.join(F.broadcast(sums), F.lit(True)).join(F.broadcast(yy), F.lit(True))  # one row each
    return all_.select((F.col("kl") + F.col("y")).alias("kl"), F.sqrt(F.greatest(F.expr("vv - 2 * vy + yy"), F.lit(0.0)) / F.col("vv")).alias("error"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in an order, found by ranges: no task holds all rows."""
    ranged = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    shift = F.create_map(*(F.lit(x) for item in before.items() for x in item))[F.col("_part")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("idx", (place - 1 + shift).cast("long")).drop("_part")


def compact(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(i, j, v) of the cells (row, col, v) that are not zero, and the maps (row, i) and (col, j) that number rows and columns in use."""
    own = cells.where("v != 0")
    rows, cols = (numbered(own.select(c).distinct(), c).withColumnRenamed("idx", n) for c, n in (("row", "i"), ("col", "j")))
    return own.join(rows, "row").join(cols, "col").select("i", "j", "v"), rows, cols


def first_seen(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """value, idx: values numbered by the first row that has them."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("_at"))
    return numbered(first, "_at").select(value, "idx")


def error_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """rmse, mae, n of two numeric columns; rows that lack one are left out."""
    d = F.col(guess).cast("double") - F.col(truth).cast("double")
    return rows.where(d.isNotNull()).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count("*").alias("n"))


def curve_areas(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """roc_auc, pr_auc (trapezoids between different scores) of a 0/1 column; sums run over ranges of scores, not in one task."""
    by = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(truth) == 0, 1).otherwise(0)).alias("q"))
    ranged = checkpointed(by.withColumn("s", -F.col("s")).repartitionByRange("s").withColumn("_part", F.spark_partition_id()))
    parts = {r["_part"]: (r["p"], r["q"]) for r in ranged.groupBy("_part").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()}  # a row per partition
    before, p, q = {}, 0, 0
    for part in sorted(parts):
        before[part] = (p, q)
        p, q = p + parts[part][0], q + parts[part][1]
    if not p or not q:
        return ranged.sparkSession.range(1).select(F.lit(None).cast("double").alias("roc_auc"), F.lit(None).cast("double").alias("pr_auc"))
    at = lambda k: F.create_map(*(F.lit(x) for part, sums in before.items() for x in (part, sums[k])))[F.col("_part")]
    own = Window.partitionBy("_part").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.select("p", "q", (F.sum("p").over(own) + at(0)).alias("tp"), (F.sum("q").over(own) + at(1)).alias("fp"))
    before_p, before_q = F.col("tp") - F.col("p"), F.col("fp") - F.col("q")
    precision = lambda a, b: F.when(a + b > 0, a / F.when(a + b > 0, a + b)).otherwise(1.0)
    roc = F.sum(F.col("q") * (F.col("tp") + before_p) / 2.0) / (float(p) * q)
    pr = F.sum(F.col("p") * (precision(F.col("tp"), F.col("fp")) + precision(before_p, before_q)) / 2.0) / p
    return run.agg(roc.alias("roc_auc"), pr.alias("pr_auc"))


def chained(rows: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], names: list[str] | None = None) -> DataFrame:
    """``rows`` through the named steps in order (all, or those of ``names``)."""
    return reduce(lambda df, name: steps[name](df), steps if names is None else names, rows)
