"""Ranked lexical search over an index of segments.

The index is a table with one row per segment, a run of documents of about
``SEGMENT`` bytes: terms, postings by term, document lengths and ids.  A search
reads it three times: sizes of the collection, document frequencies of the
queries' terms, and the ranking itself.  Queries go in blocks of bounded bytes to
every task; a task goes through its segments with one list of best documents per
query, so that what it has found in one segment lets it skip in the next, and
hands over at most k documents per query.

In a segment a query's short postings are added up first (term at a time) into one
sorted list of documents with summed scores.  From then on this list is one
iterator among the long ones, with the largest sum as its bound, and ranking goes
document at a time: iterators whose bounds together stay under the k-th best score
propose no documents, they are only looked up for documents that others propose
and whose score so far, with the bounds still open, can reach the k-th best.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) and a document scores
weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L, over the query's
terms, each once; all bounds are exact integers, so skipping loses nothing.

Null and empty texts hold no term: as documents they are not counted and never
found, as queries they have no rows.  Equal scores rank by ascending doc_id, null
ids last.  Rows are documents and queries of their own, ids repeated or not.  Empty
tables give no rows.  Columns other than the id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage_folder
from .common import A_Z, runs_of_rows
from .packed import pack, unpack

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text in a segment.
SEGMENT = 16_000_000
#: Bytes of query texts that are handled together.
QUERY_BYTES = 2_000_000
#: Postings that are added up before documents are ranked, as a share of the segment's documents; one list at least.
SHORT = 1 / 8
#: Documents that an iterator proposes at a time.
STEP = 512
BEST = 50
INDEX = "ids array<long>, sizes binary, terms binary, postings binary, lists binary, n_docs long, n_terms long"
#: A-Z lowered, bytes outside terms made spaces; bytes of other characters are over 0x7F.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(text: bytes, most: int = 8_000_000) -> Counter:
    """Occurrences of each term; texts of over ``most`` bytes go in parts."""
    data, at, out = text.translate(_TABLE), 0, Counter()
    while len(data) - at > most:
        cut = data.find(b" ", at + most)
        if cut < 0:
            break
        out.update(data[at:cut].split())
        at = cut
    out.update((data[at:] if at else data).split())
    return out


class Building:
    """Documents of a segment that is being built."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.known, self.terms, self.docs, self.counts, self.bytes = [], [], {}, [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts = term_counts(text)
        if not counts:
            return
        known, doc = self.known, len(self.ids)
        self.terms += [known.setdefault(t, len(known)) for t in counts]
        self.counts += counts.values()
        self.docs += [doc] * len(counts)
        self.ids.append(doc_id)
        self.sizes.append(sum(counts.values()))
        self.bytes += len(text)

    def row(self) -> dict:
        """Terms in order of first appearance; postings behind one another by term, then document."""
        terms = np.array(self.terms, np.uint32)
        order = np.argsort(terms, kind="stable")
        return {
            "ids": self.ids,
            "sizes": pack(np.array(self.sizes, np.uint64)),
            "terms": b" ".join(self.known),
            "postings": pack(np.array(self.docs, np.uint32)[order], np.array(self.counts, np.uint32)[order]),
            "lists": pack(np.bincount(terms).astype(np.uint32)),
            "n_docs": len(self.ids),
            "n_terms": sum(self.sizes),
        }


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Writes the segments of ``docs`` to ``path`` and gives the table read back from there."""
    arrow = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("terms", pa.binary()), ("postings", pa.binary()), ("lists", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Building()
        for batch in runs_of_rows(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                segment.add(doc_id, text)
                if segment.bytes >= SEGMENT:
                    yield pa.RecordBatch.from_pylist([segment.row()], arrow)
                    segment = Building()
        if segment.ids:
            yield pa.RecordBatch.from_pylist([segment.row()], arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows.mapInArrow(run, INDEX).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


class Segment:
    """One row of the index, ready for the terms of ``weights`` (term: weight)."""

    def __init__(self, row: dict, weights: dict[bytes, int], n: int, total: int) -> None:
        self.ids = row["ids"]
        self.n_docs = len(self.ids)
        self.docs, self.tf = unpack(row["postings"])
        self.ends = np.cumsum(unpack(row["lists"])[0], dtype=np.int64)
        self.place = {t: i for i, t in enumerate(row["terms"].split(b" ")) if t in weights}
        self.weights, self.lists = weights, {}
        self.m20 = np.array([20 * (50 + 50 * size * n // total) for size in unpack(row["sizes"])[0].tolist()], np.int64)

    def postings(self, term: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Documents, their scores for the term, and the largest of these."""
        i = self.place.get(term)
        if i is None:
            return None
        out = self.lists.get(i)
        if out is None:
            part = slice(self.ends[i - 1] if i else 0, self.ends[i])
            docs, tf = self.docs[part].astype(np.int64), self.tf[part].astype(np.int64)
            scores = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + self.m20[docs]))
            out = self.lists[i] = (docs, scores, int(scores.max()))
        return out


def added_up(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different documents in order and the sums of their scores."""
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return docs[starts], np.add.reduceat(scores, starts) if len(docs) else scores


class Best:
    """The k best documents of a query: scores descending, then ids ascending, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score under this cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        self.scores = np.concatenate([self.scores, scores])
        self.ids = np.concatenate([self.ids, np.array([i or 0 for i in ids], np.int64)])
        self.null = np.concatenate([self.null, np.array([i is None for i in ids], bool)])
        order = np.lexsort((self.ids, self.null, -self.scores))[: self.k]
        self.scores, self.ids, self.null = self.scores[order], self.ids[order], self.null[order]


def rank_segment(segment: Segment, terms: list[bytes], best: Best) -> int:
    """Takes what the segment has for a query into ``best``; the number of documents proposed."""
    lists = sorted((p for p in map(segment.postings, terms) if p is not None and p[2]), key=lambda p: len(p[0]))
    if not lists or sum(p[2] for p in lists) < best.least:
        return 0
    short, held = 1, len(lists[0][0])
    while short < len(lists) and held + len(lists[short][0]) <= SHORT * segment.n_docs:
        held += len(lists[short][0])
        short += 1
    docs, scores = added_up(np.concatenate([p[0] for p in lists[:short]]), np.concatenate([p[1] for p in lists[:short]]))
    iterators = sorted([(docs, scores, int(scores.max())), *lists[short:]], key=lambda p: p[2])
    open_bounds = np.concatenate([[0], np.cumsum([p[2] for p in iterators])]).tolist()
    # k documents have these sums at least, so none under the k-th of them is wanted
    floor = int(np.partition(scores, -best.k)[-best.k]) if len(scores) >= best.k else 0
    at, proposed = 0, 0
    while True:
        least = max(best.least, floor)
        first = sum(b < least for b in open_bounds[1:])  # those before it cannot lift a document to the k-th best together
        here = [(p, int(np.searchsorted(p[0], at))) for p in iterators[first:]]
        here = [(p, i) for p, i in here if i < len(p[0])]
        if not here:
            return proposed
        upto = min((int(p[0][i + STEP - 1]) for p, i in here if i + STEP <= len(p[0])), default=segment.n_docs)
        parts = [(p, slice(i, int(np.searchsorted(p[0], upto, side="right")))) for p, i in here]
        docs, scores = added_up(np.concatenate([p[0][s] for p, s in parts]), np.concatenate([p[1][s] for p, s in parts]))
        proposed += len(docs)
        for k in range(first - 1, -1, -1):
            alive = scores + open_bounds[k + 1] >= least
            docs, scores = docs[alive], scores[alive]
            if not len(docs):
                break
            own, gains, _ = iterators[k]
            place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            scores = scores + np.where(own[place] == docs, gains[place], 0)
        alive = scores >= least
        if alive.any():
            best.add(scores[alive], [segment.ids[d] for d in docs[alive].tolist()])
        at = upto + 1


def query_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Queries (item_id, terms) in blocks of about QUERY_BYTES of text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES))
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield [(r["item_id"], terms) for r in own if (terms := sorted(term_counts(bytes(r["text"]))))]


def document_frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the terms stands (a row for each term at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for terms, lists in zip(batch.column("terms"), batch.column("lists"), strict=True):
                sizes = unpack(lists.as_py())[0]
                for i, t in enumerate(terms.as_py().split(b" ")):
                    if t in wanted:
                        found[t] += int(sizes[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    counted = index.select("terms", "lists").mapInArrow(run, "term binary, df long")
    return {bytes(r["term"]): r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _search_block(index: DataFrame, block: list[tuple[int | None, list[bytes]]], n: int, total: int, k: int) -> DataFrame:
    found = document_frequencies(index, {t for _, terms in block for t in terms})
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in found.items()}
    queries = [[t for t in terms if t in weights] for _, terms in block]
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], weights, n, total)
                for terms, own in zip(queries, best, strict=True):
                    rank_segment(segment, terms, own)
        for q, own in enumerate(best):
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.ids), q)), pa.array(own.ids, mask=own.null), pa.array(own.scores)], ["query", "doc_id", "score"])

    rows = index.drop("n_docs", "n_terms").mapInArrow(run, "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = index.sparkSession.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query long, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item.

    With more than one block of queries each block's rows are written beside the checkpoints, so that plans and broadcasts stay small.
    """
    spark = index.sparkSession
    whole = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    n, total = whole["n"] or 0, whole["total"] or 1
    folder, last, written = stage_folder(spark), None, False
    for block in query_blocks(items):
        if last is not None:
            last.write.mode("append").parquet(folder)
            written = True
        last = _search_block(index, block, n, total, k)
    if written:
        last.write.mode("append").parquet(folder)
        last = spark.read.parquet(folder)
    return last


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """Index and search in one, the index beside the checkpoints."""
    return search(build_index(docs, f"{stage_folder(docs.sparkSession)}/index"), items, k)


def search_sql(k: int = BEST) -> str:
    """The same rows in DuckDB SQL, every document scored."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{A_Z}', '{A_Z.lower()}'), '{TERM}')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM s),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN s USING (doc_id), g GROUP BY item_id, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""
