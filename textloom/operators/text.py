"""Word statistics, language filter, term attribution and search over document tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_tokens, phrase_pattern

#: Bytes of text that are weighed together in one group.
BUCKET = 16_000_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token, tf: one row per document and different token."""
    return docs.select(id_col, F.explode(lower_tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))


def word_counts(docs: DataFrame, words: Column) -> DataFrame:
    """word, tf, df of an array column: each row is one document, so one shuffle of map-side sums does."""
    marked = F.concat(F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(0).alias("first"))), F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), F.lit(1).alias("first"))))
    rows = docs.select(F.explode(marked).alias("x")).select("x.*")
    return rows.groupBy("word").agg(F.sum(1 - F.col("first")).alias("tf"), F.sum("first").alias("df"))


def _texts_by_id(table: pa.Table) -> dict:
    """The text of each id as bytes, those of a repeated id one behind the other."""
    ids, texts = table["id"].to_pylist(), table["low"].cast(pa.binary()).to_pylist()
    own = dict(zip(ids, texts, strict=True))
    if len(own) < len(ids):
        parts: dict = {}
        for i, t in zip(ids, texts, strict=True):
            parts.setdefault(i, []).append(t)
        own = {i: b" ".join(t) for i, t in parts.items()}
    return own


def _counted(key: tuple, table: pa.Table) -> pa.Table:
    seen: Counter = Counter()
    for text in _texts_by_id(table).values():
        seen.update(set(text.split()))
    buckets = pa.array(np.full(len(seen), key[0].as_py(), np.int32))
    return pa.table([buckets, pa.array(seen, pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["bucket", "token", "df"])


def weighed(docs: DataFrame, min_df: int = 1, max_df: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, norm and words (token, tf, raw) of each document: raw is tf * (ln((1 + n) / (1 + df)) + 1), norm the root of its squares' sum.

    Words in fewer than min_df documents, or more than the share max_df of the n, are left out,
    and documents without any other.  Texts go to buckets of some bytes once; what is counted over
    all documents is a row for each bucket and different word, and only these rows come back to the texts.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    n, buckets = size["n"], max(8, -(-(size["bytes"] or 0) // BUCKET))
    # split() of bytes knows the white space of lower_tokens
    own = docs.select(F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("bucket"), F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("low"))
    counts = own.groupBy("bucket").applyInArrow(_counted, "bucket int, token string, df long")
    known = counts.withColumn("df", F.sum("df").over(Window.partitionBy("token"))).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))

    def weigh(texts: pa.Table, words: pa.Table) -> pa.Table:
        tokens, df = words["token"].combine_chunks(), words["df"].to_numpy()
        idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
        place = dict(zip(tokens.cast(pa.binary()).to_pylist(), range(len(tokens)), strict=True))
        ids, at, tf, ends = [], [], [], [0]
        for i, text in _texts_by_id(texts).items():
            found = Counter(text.split())
            there = list(map(place.get, found, repeat(-1)))
            at.append(np.array(there, np.int64))
            tf.append(np.fromiter(found.values(), np.int64, len(found)))
            kept = at[-1] >= 0
            at[-1], tf[-1] = at[-1][kept], tf[-1][kept]
            if len(at[-1]):
                ids.append(i)
                ends.append(ends[-1] + len(at[-1]))
        at, tf = (np.concatenate([np.empty(0, np.int64), *x]) for x in (at, tf))
        raw = tf * idf[at]
        norm = np.sqrt(np.add.reduceat(raw * raw, ends[:-1])) if ids else np.empty(0)
        cells = pa.StructArray.from_arrays([tokens.take(pa.array(at)), pa.array(tf), pa.array(raw)], ["token", "tf", "raw"])
        return pa.table([pa.array(ids, texts.schema.field("id").type), pa.array(norm), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], ["id", "norm", "words"])

    kind = own.schema["id"].dataType.simpleString()
    rows = own.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(weigh, f"id {kind}, norm double, words array<struct<token:string,tf:bigint,raw:double>>")
    return rows.withColumnRenamed("id", id_col)


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token, n_docs, first_doc, last_doc; each row is one document."""
    once = docs.select(id_col, F.explode(F.array_distinct(lower_tokens(F.col(text_col)))).alias("token"))
    return once.groupBy("token").agg(F.count("*").alias("n_docs"), F.min(id_col).alias("first_doc"), F.max(id_col).alias("last_doc"))


def grams(c: Column, n: int) -> Column:
    """The strings of n consecutive words."""
    words = lower_tokens(c)
    out = words
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, k + 1, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda g: g.isNotNull())


def top_words(docs: DataFrame, top_n: int = 100, n_gram: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, tf, df, df_fraction (of documents), tf_fraction (of different grams): the top_n by tf, ties by word."""
    tokens = lower_tokens(F.col(text_col)) if n_gram == 1 else grams(F.col(text_col), n_gram)
    words = word_counts(docs, tokens)
    sizes = words.agg(F.count("*").alias("grams")).join(docs.agg(F.count("*").alias("docs")), how="inner", on=F.lit(True))
    top = words.orderBy(F.desc("tf"), "word").limit(top_n)
    return top.join(F.broadcast(sizes), F.lit(True)).select("word", "tf", "df", (F.col("df") / F.col("docs")).alias("df_fraction"), (F.col("tf") / F.col("grams")).alias("tf_fraction"))


def term_counts(docs: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """term, tf, df of literal substrings, in one pass: a row per term."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    hits = [((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)).cast("long") for t in terms]
    sums = [x for i, h in enumerate(hits) for x in (F.coalesce(F.sum(h), F.lit(0)).alias(f"tf{i}"), F.coalesce(F.sum((h > 0).cast("long")), F.lit(0)).alias(f"df{i}"))]
    rows = F.inline(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"tf{i}").alias("tf"), F.col(f"df{i}").alias("df")) for i, t in enumerate(terms))))
    return docs.agg(*sums).select(rows)


def term_attribution(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, id, tf: one row for each document that has a term as a token."""
    return postings(docs, id_col, text_col).where(F.col("token").isin([t.lower() for t in terms])).select(F.col("token").alias("term"), id_col, "tf")


def term_columns(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, terms: the comma-joined terms that stand in the text as substrings of either case."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t)))
    return docs.select(id_col, F.array_join(found, ", ").alias("terms"))


def english_only(docs: DataFrame, stop_words: list[str], ascii_ratio: float = 0.9, stop_ratio: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ascii_share, stop_share, english: by the ASCII share of visible characters and the share of stop words."""
    solid = F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\s+", "")
    plain = F.length(F.regexp_replace(solid, r"[^\x00-\x7F]", ""))
    words = lower_tokens(F.col(text_col))
    stops = F.size(F.filter(words, lambda w: w.isin(stop_words)))
    shares = docs.select(id_col, (plain / F.greatest(F.length(solid), F.lit(1))).alias("ascii_share"), (stops / F.greatest(F.size(words), F.lit(1))).alias("stop_share"))
    return shares.withColumn("english", (F.col("ascii_share") >= ascii_ratio) & (F.col("stop_share") >= stop_ratio))


def has_all(text: Column, words: list[str]) -> Column:
    found = lower_tokens(text)
    out = F.lit(True)
    for w in words:
        out = out & F.array_contains(found, w.lower())
    return out


def search(docs: DataFrame, any_of: list[list[str]], positives: list[str] = (), negatives: list[str] = (), text_col: str = "text") -> DataFrame:
    """Rows that have all words of some query, all positives and no negative."""
    words = lower_tokens(F.col(text_col))
    hit = F.lit(False)
    for query in any_of:
        hit = hit | F.forall(F.array(*map(F.lit, query)), lambda q: F.array_contains(words, q))
    for w in positives:
        hit = hit & F.array_contains(words, w)
    for w in negatives:
        hit = hit & ~F.array_contains(words, w)
    return docs.where(hit)


def ordered_window(docs: DataFrame, words: list[str], window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids whose text has two words in this order within ``window`` tokens, by a band join on positions inside each document."""
    first, second = (w.lower() for w in words)
    at = docs.select(id_col, F.posexplode(lower_tokens(F.col(text_col))).alias("pos", "token")).where(F.col("token").isin(first, second))
    after = Window.partitionBy(id_col).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    near = at.withColumn("next", F.min(F.when(F.col("token") == second, F.col("pos"))).over(after))
    return near.where((F.col("token") == first) & (F.col("next") - F.col("pos") < window)).select(id_col).distinct()


def rule_matches(docs: DataFrame, rules: dict[str, dict[str, list[str]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rule: the first rule whose main phrase stands in the text, with its positives (any) and without its negatives."""
    has = lambda p: F.col(text_col).rlike(phrase_pattern(p))

    def fits(main: str, parts: dict[str, list[str]]) -> Column:
        out = has(main)
        if parts.get("negatives"):
            out = out & ~F.greatest(*map(has, parts["negatives"])) if len(parts["negatives"]) > 1 else out & ~has(parts["negatives"][0])
        if parts.get("positives"):
            out = out & (F.greatest(*map(has, parts["positives"])) if len(parts["positives"]) > 1 else has(parts["positives"][0]))
        return out

    rule = F.coalesce(*(F.when(fits(main, parts), F.lit(main)) for main, parts in rules.items()))
    return docs.select(id_col, rule.alias("rule")).where(F.col("rule").isNotNull())


def near_words(docs: DataFrame, min_df: int, distance: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, kept: words of one first letter within an edit distance; kept is the more frequent (ties: b).

    Words of equal length or one more are compared under their deletion variants, so
    pairs are never made by first letter alone.
    """
    words = word_counts(docs, lower_tokens(F.col(text_col))).withColumnRenamed("word", "token").where((F.col("df") >= min_df) & F.col("token").rlike("^[a-z]{2,}$"))
    cut = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring(F.col("token"), F.lit(1), i - 1), F.substring(F.col("token"), i + 1, F.length("token"))))
    keyed = words.select("token", "tf", F.explode(F.array_distinct(F.array_append(cut, F.col("token")))).alias("key"))
    pairs = keyed.select("key", F.col("token").alias("a"), F.col("tf").alias("tf_a")).join(keyed.select("key", F.col("token").alias("b"), F.col("tf").alias("tf_b")), "key")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.levenshtein("a", "b") <= distance))
    return pairs.select("a", "b", F.when(F.col("tf_a") > F.col("tf_b"), F.col("a")).otherwise(F.col("b")).alias("kept")).distinct()


def shared_words(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """term, n, tokens from rows (top, tokens): how many rows have a term in top, and the tokens all of them have.

    Rows of a term are put together as they come; what is held is given out when it has ``most`` tokens.
    """
    held: dict[str, tuple[int, set[str]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        columns = [pa.array(held, pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([list(x) for _, x in held.values()], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["term", "n", "tokens"])

    for batch in batches:
        for i in range(batch.num_rows):
            own = set(batch.column("tokens")[i].as_py())
            for term in batch.column("top")[i].as_py():
                n, before = held.get(term, (0, None))
                now = own if before is None else before & own
                size += len(now) - len(before or ())
                held[term] = n + 1, now
            if size >= most:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def term_rules(docs: DataFrame, top_n: int, min_df: int, least_docs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, support, n_docs: terms among the ``top_n`` of a document by tf-idf, and the words that stand in all documents where they are.

    The words of a term's documents are intersected within each task and then across tasks, so pairs are
    made only of words that are left.  Documents without an id count, and have no word beside a term.
    """
    words = weighed(docs, min_df, 1.0, id_col, text_col)
    first = F.slice(F.sort_array(F.transform("words", lambda x: F.struct((-F.round(x["raw"], 9)).alias("place"), x["token"].alias("token")))), 1, top_n)
    tokens = F.when(F.col(id_col).isNotNull(), F.col("words.token")).otherwise(F.array().cast("array<string>"))
    held = words.select(first["token"].alias("top"), tokens.alias("tokens")).mapInArrow(shared_words, "term string, n long, tokens array<string>")
    by_term = held.groupBy("term").agg(F.sum("n").alias("n_docs"), F.collect_list("tokens").alias("all")).where(F.col("n_docs") >= least_docs)
    left = by_term.select("term", F.aggregate("all", F.col("all")[0], F.array_intersect).alias("left"), "n_docs")
    return left.select("term", F.explode("left").alias("support"), "n_docs").where("term != support")
