"""Vocabularies, weighted matrices and bibliographic tensors in coordinate form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_tokens
from ..shared import checkpointed
from .text import postings, weighed, word_counts

#: Words of a vocabulary that is sent to every task.
MOST_BROADCAST = 500_000


def vocabulary(docs: DataFrame, min_df: int = 1, max_df: float = 1.0, id_col: str = "doc_id", text_col: str = "text", max_features: int | None = None) -> DataFrame:
    """token, df of tokens in at least min_df documents and at most the share max_df of them; the ``max_features`` most frequent, ties by token."""
    n = docs.count()
    words = word_counts(docs, lower_tokens(F.col(text_col))).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if max_features:
        words = words.orderBy(F.desc("tf"), "word").limit(max_features)
    return words.select(F.col("word").alias("token"), "df")


def tf_idf(docs: DataFrame, min_df: int = 1, max_df: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token, tf, weight: tf * (ln((1 + n) / (1 + df)) + 1), of length 1 in each document."""
    words = weighed(docs, min_df, max_df, id_col, text_col)
    return words.select(id_col, "norm", F.inline("words")).select(id_col, "token", "tf", (F.col("raw") / F.col("norm")).alias("weight"))


def co_occurrence(docs: DataFrame, words: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n: symmetric counts of vocabulary words (column token) at most ``window`` tokens apart; equal words count twice.

    The words behind each word are laid beside it in its own row, so documents are not joined with themselves.
    A vocabulary of up to MOST_BROADCAST words goes to the texts; a larger one meets them by word.
    """
    known = checkpointed(words.select(F.col("token").alias("known")))
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    at = docs.select(id_col, F.posexplode(lower_tokens(F.col(text_col))).alias("pos", "token")).join(known, F.col("token") == F.col("known")).drop("known")
    ahead = Window.partitionBy(id_col).orderBy("pos").rangeBetween(1, window)
    pairs = at.withColumn("others", F.collect_list("token").over(ahead)).select("token", F.explode("others").alias("other"))
    halves = pairs.groupBy("token", "other").agg(F.count("*").alias("n"))
    both = halves.select(F.col("token").alias("a"), F.col("other").alias("b"), "n").unionByName(halves.select(F.col("other").alias("a"), F.col("token").alias("b"), "n"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n"))


def sppmi(counts: DataFrame, shift: float = 0.0) -> DataFrame:
    """a, b, value: max(ln(n * total / (row * column)) - shift, 0), zeros left out."""
    rows = counts.groupBy("a").agg(F.sum("n").alias("row"))
    columns = counts.groupBy("b").agg(F.sum("n").alias("column"))
    total = counts.agg(F.sum("n").alias("total"))
    value = F.log(F.col("n").cast("double") * F.col("total") / (F.col("row").cast("double") * F.col("column"))) - shift
    joined = counts.join(rows, "a").join(columns, "b").join(F.broadcast(total), F.lit(True))
    return joined.select("a", "b", value.alias("value")).where(F.col("value") > 0)


def co_authors(papers: DataFrame) -> DataFrame:
    """a, b, year, n from rows (paper, author, year): ordered pairs of different authors of a paper."""
    own = papers.select("paper", "author", "year").distinct()
    left, right = own.withColumnRenamed("author", "a"), own.select("paper", F.col("author").alias("b"))
    return left.join(right, "paper").where("a <> b").groupBy("a", "b", "year").agg(F.count("*").alias("n"))


def participation(papers: DataFrame) -> DataFrame:
    """author, paper, year, value 1."""
    return papers.select("author", "paper", "year").distinct().withColumn("value", F.lit(1))


def citations(papers: DataFrame, references: DataFrame) -> DataFrame:
    """author, cited, year, n from references (paper, cited); papers outside the corpus are left out."""
    own = papers.select("paper", "author", "year").distinct()
    inside = references.join(own.select(F.col("paper").alias("cited")).distinct(), "cited", "left_semi")
    return own.join(inside, "paper").groupBy("author", "cited", "year").agg(F.count("*").alias("n"))


def co_citations(papers: DataFrame, references: DataFrame) -> DataFrame:
    """author, cited_author, year, weight: each citation gives 1 / (authors of the cited paper) to each of these."""
    own = papers.select("paper", "author", "year").distinct()
    cited = own.select(F.col("paper").alias("cited"), F.col("author").alias("cited_author"))
    share = cited.groupBy("cited").agg((1.0 / F.count("*")).alias("share"))
    return own.join(references, "paper").join(share, "cited").join(cited, "cited").groupBy("author", "cited_author", "year").agg(F.sum("share").alias("weight"))


def entity_word_time(rows: DataFrame, entity: str, time: str, text_col: str = "text") -> DataFrame:
    """entity, word, time, n."""
    return rows.select(entity, F.explode(lower_tokens(F.col(text_col))).alias("word"), time).groupBy(entity, "word", time).agg(F.count("*").alias("n"))


def unfold(tensor: DataFrame, mode: str, others: tuple[str, str], size: int, value: str = "v") -> DataFrame:
    """row, col, v: mode-n matricisation in row-major order; size is that of the last of ``others``."""
    return tensor.select(F.col(mode).alias("row"), (F.col(others[0]) * size + F.col(others[1])).alias("col"), F.col(value).alias("v"))


def fold(matrix: DataFrame, mode: str, others: tuple[str, str], size: int) -> DataFrame:
    """The tensor that ``unfold`` gave."""
    return matrix.select(F.col("row").alias(mode), F.floor(F.col("col") / size).cast("long").alias(others[0]), (F.col("col") % size).alias(others[1]), "v")


def highlighted(weights: DataFrame, words: dict[str, float], token: str = "token") -> DataFrame:
    """``weights`` with those of the given words multiplied."""
    factor = F.create_map(*(F.lit(x) for w, by in sorted(words.items()) for x in (w, by)))[F.col(token)]
    return weights.withColumn("weight", F.col("weight") * F.coalesce(factor, F.lit(1.0)))


def entity_tf_idf(rows: DataFrame, entity: str, text_col: str = "text") -> DataFrame:
    """entity, token, weight: tf-idf with each entity's texts taken together, of length 1."""
    n = rows.select(entity).distinct().count()
    per = rows.select(entity, F.explode(lower_tokens(F.col(text_col))).alias("token")).groupBy(entity, "token").agg(F.count("*").alias("tf"))
    df = per.groupBy("token").agg(F.count("*").alias("df"))
    raw = per.join(df, "token").withColumn("raw", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norms = raw.groupBy(entity).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, entity).select(entity, "token", (F.col("raw") / F.col("norm")).alias("weight"))


def positional_pairs(papers: DataFrame, author_ids: str = "author_ids") -> DataFrame:
    """a, b, year, n from ``;`` lists: both directions of each pair of places, blank items left out; an author named twice meets itself."""
    items = F.filter(F.transform(F.split(author_ids, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.flatten(F.transform(items, lambda a, i: F.transform(F.filter(F.transform(items, lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda y: y["j"] != i), lambda y: F.struct(a.alias("a"), y["b"].alias("b")))))
    return papers.select("year", F.explode(pairs).alias("p")).groupBy("p.a", "p.b", "year").agg(F.count("*").alias("n"))


def flatten_time(cells: DataFrame, keys: tuple[str, str] = ("a", "b"), value: str = "n") -> DataFrame:
    """The cells summed over all other columns."""
    return cells.groupBy(*keys).agg(F.sum(value).alias(value))


def co_dependency(rows: DataFrame, item: str, group: str) -> DataFrame:
    """a, b, n for a < b: groups that two items share."""
    own = rows.where(F.col(item).isNotNull() & F.col(group).isNotNull()).select(group, item).distinct()
    left, right = own.select(group, F.col(item).alias("a")), own.select(group, F.col(item).alias("b"))
    return left.join(right, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def sample_mask(cells: DataFrame, share: float, stratum: str | None = None, seed: int = 0) -> DataFrame:
    """``cells`` (row, col, v) with mask: 0 for the floor of ``share`` of the cells (of each stratum), by the order of a hash, else 1.

    Hashes are counted in 1000 bins first; only the bin where the share ends is ordered.
    """
    hashed = cells.withColumn("_h", F.xxhash64("row", "col", F.lit(seed))).withColumn("_bin", F.pmod(F.shiftright("_h", 20), F.lit(1000)))
    keys = [stratum] if stratum else []
    hashed = hashed.withColumn("_all", F.lit(0))
    keys = [*keys, "_all"]
    counts = hashed.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*keys).orderBy("_bin")
    counts = counts.withColumn("_before", F.sum("_n").over(run) - F.col("_n")).withColumn("_want", F.floor(F.sum("_n").over(Window.partitionBy(*keys)) * share))
    placed = hashed.join(counts, [*keys, "_bin"])
    edge = placed.where("_before < _want AND _before + _n > _want").withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_h", "row", "col")))
    rest = placed.where("NOT (_before < _want AND _before + _n > _want)").withColumn("_place", F.lit(0))
    mask = F.when(F.col("_before") + F.when(F.col("_place") > 0, F.col("_place")).otherwise(F.col("_n")) <= F.col("_want"), 0).otherwise(1)
    return edge.unionByName(rest).select(*cells.columns, mask.alias("mask"))


def move_axis(tensor: DataFrame, order: tuple[str, ...], names: tuple[str, ...] = ("i", "j", "t")) -> DataFrame:
    """The tensor with its modes in another order."""
    rest = [c for c in tensor.columns if c not in names]
    return tensor.select(*(F.col(old).alias(new) for old, new in zip(order, names, strict=True)), *rest)


def affinities(points: DataFrame, neighbour: int = 7) -> DataFrame:
    """i, j, value of points (id, x: array): exp(-d^2 / (s_i s_j)), s the distance to the so-manieth neighbour; no diagonal.

    All pairs of points are the result, so points are a small table here (as for a consensus matrix).
    """
    x, y = points.select(F.col("id").alias("i"), F.col("x").alias("a")), points.select(F.col("id").alias("j"), F.col("x").alias("b"))
    square = F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    d = checkpointed(x.join(y, F.col("i") != F.col("j")).select("i", "j", square.alias("dd")))
    place = F.row_number().over(Window.partitionBy("i").orderBy("dd", "j"))
    scale = d.withColumn("place", place).where(F.col("place") == neighbour).select("i", F.sqrt("dd").alias("s"))
    both = d.join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
    return both.select("i", "j", F.exp(-F.col("dd") / (F.col("s") * F.col("sj"))).alias("value"))
