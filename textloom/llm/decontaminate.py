"""Benchmark decontamination: short test items found inside long documents.

Containment (the share of an item's five-word shingles that a document has) is
searched with MinHash.  A long document has so many more shingles than an item that
their Jaccard similarity says nothing, so both are partitioned by size: items by
powers of two of their number of shingles, and for items of up to ``u`` shingles each
document is taken in windows of ``2u`` that start every ``u``.  A passage of an item
lies whole in some window, where a containment of 0.8 makes a Jaccard similarity of at
least 0.19, so that of 32 minima at least one agrees in over 99.8 % of such pairs.
Each agreement makes a candidate, and candidates are verified by exact containment:
the item's shingles, as texts, against those of the whole document.

An item whose shingles are spread over a document need not agree with any window.  It
is found by prefix: a document that has 0.8 of an item's n shingles has one of any
n - ceil(0.8 n) + 1 of them, so documents are also looked up by so many shingles of
each item (those with the smallest hashes).  No link is lost.

Items are the query side.  They are taken in blocks of bounded size (``BLOCK`` bytes
of text), each block's minima broadcast to all documents; documents are not shuffled.

Null and empty documents contain nothing; items without words are in nothing; an item
of n words, n under five, has one shingle, and a document contains it if these words
stand in it one behind the other.  Repeated rows of either side are all reported.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Batch
from .common import ids_and_texts, runs_of_rows

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 32
BLOCK = 4_000_000
MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_texts(text: bytes, n: int = SHINGLE) -> set[bytes]:
    words = text.lower().split()
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def sorted_pairs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def looked_up(hashes: np.ndarray, of: np.ndarray, keys: np.ndarray, values: np.ndarray) -> set[tuple[int, int]]:
    """(of, value) of each hash among the sorted keys."""
    if not len(keys) or not len(hashes):
        return set()
    left = np.searchsorted(keys, hashes)
    hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == hashes)
    right = np.searchsorted(keys, hashes[hit], side="right")
    return {(w, i) for w, a, b in zip(of[hit].tolist(), left[hit].tolist(), right.tolist(), strict=True) for i in values[a:b].tolist()}


class Items:
    """A block of items: their shingles, and their minima by size class and hash function."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = THRESHOLD) -> None:
        rows = [(i, t.encode()) for i, t in rows if t and t.split()]
        self.ids = [i for i, _ in rows]
        self.shingles = [shingle_texts(t) for _, t in rows]
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.short, self.prefix = {}, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if not rows:
            return
        hashes, of = Batch([t.lower() for _, t in rows]).shingles(SHINGLE)
        n_words = np.array([len(t.split()) for _, t in rows])
        #: for items of fewer words: by their number, sorted hashes and items
        self.short = {}
        for k in sorted(set(n_words[n_words < SHINGLE].tolist())):
            own = np.flatnonzero(n_words == k)
            grams, where = Batch([rows[i][1].lower() for i in own.tolist()]).shingles(k)
            self.short[k] = sorted_pairs(grams, own[where])
        long = n_words[of] >= SHINGLE
        self.few = set(np.flatnonzero(n_words < SHINGLE).tolist())
        order = np.lexsort((hashes[long], of[long]))
        value, item = hashes[long][order], of[long][order]
        new = np.append(True, (value[1:] != value[:-1]) | (item[1:] != item[:-1])) if len(value) else np.zeros(0, bool)
        value, item = value[new], item[new]
        size = np.bincount(item, minlength=len(rows))
        place = np.arange(len(value)) - (np.cumsum(size) - size)[item]
        first = place <= (size - np.ceil(threshold * size - 1e-9))[item]
        self.prefix = sorted_pairs(value[first], item[first])
        upper = np.array([1 << max(0, len(s) - 1).bit_length() for s in self.shingles])
        starts = np.searchsorted(of, np.arange(len(rows)))
        minima = [np.minimum.reduceat(hashes * m, starts) for m in MULTIPLIERS]
        for u in sorted(set(upper.tolist())):
            own = np.flatnonzero(upper == u)
            self.classes[u] = []
            for low in minima:
                order = own[np.argsort(low[own], kind="stable")]
                self.classes[u].append((low[order], order))

    def candidates(self, hashes: np.ndarray, of: np.ndarray, n_texts: int) -> set[tuple[int, int]]:
        """(text, item) pairs with an equal minimum in some window."""
        found = set()
        if not len(hashes):
            return found
        size = np.bincount(of, minlength=n_texts)
        begin = np.cumsum(size) - size
        cuts = {}
        for u in self.classes:
            blocks = -(-size // u)
            text = np.repeat(np.arange(n_texts), blocks)
            start = begin[text] + u * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            cuts[u] = (text, start, text[1:] == text[:-1])
        for k, m in enumerate(MULTIPLIERS):
            values = hashes * m
            for u, (text, start, joined) in cuts.items():
                low = np.minimum.reduceat(values, start)
                window = low.copy()
                np.minimum(window[:-1], low[1:], out=window[:-1], where=joined)
                keys, items = self.classes[u][k]
                found.update(looked_up(window, text, keys, items))
        return found | looked_up(hashes, of, *self.prefix)

    def matches(self, texts: list[bytes], threshold: float) -> list[tuple[int, int, int]]:
        """(text, item, shingles found) with containment of at least ``threshold``."""
        texts = [t.lower() for t in texts]
        hashes, of = Batch(texts).shingles(SHINGLE)
        out, last, have = [], -1, set()
        for k, known in self.short.items():
            grams, where = Batch(texts).shingles(k)
            for text, item in sorted(looked_up(grams, where, *known)):
                words = texts[text].split()
                if any(b" ".join(words[i : i + k]) in self.shingles[item] for i in range(len(words) - k + 1)):
                    out.append((text, item, 1))
        for text, item in sorted(self.candidates(hashes, of, len(texts))):
            if text != last:
                last, have = text, shingle_texts(texts[text])
            n = len(self.shingles[item] & have)
            if n and item not in self.few and n >= threshold * len(self.shingles[item]) - 1e-9:
                out.append((text, item, n))
        return out


def item_blocks(items: DataFrame, threshold: float) -> Iterator[Items]:
    """The items in blocks of about BLOCK bytes of text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Items([(r["item_id"], r["text"]) for r in own.collect()], threshold)


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles (different ones of the item), n_found, containment of each leak."""
    spark, docs = docs.sparkSession, ids_and_texts(docs)
    out = None
    for block in item_blocks(items, threshold):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in runs_of_rows(batches):
                found = own.matches([t.encode() for t in batch.column("text").to_pylist()], threshold)
                ids = batch.column("doc_id").take(pa.array([t for t, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([own.ids[i] for _, i, _ in found], pa.int64()), pa.array([len(own.shingles[i]) for _, i, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int64())],
                    ["doc_id", "item_id", "n_shingles", "n_found"],
                )

        part = docs.mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_found long")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item; judged where they stand."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    for block in item_blocks(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in runs_of_rows(batches):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                leaks = {t for t, _, _ in shared.value.matches(texts, threshold)}
                yield batch.filter(pa.array([i not in leaks for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
