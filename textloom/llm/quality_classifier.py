"""Supervised subword embeddings that tell good documents from poor ones.

A document is the average of learned vectors: of its words, its word pairs and its
character (byte) n-grams, each hashed to one of ``BUCKETS`` rows of a table, and of a
few hashed marks that no single n-gram shows: a word that repeats the one before it,
a five-word string that stood earlier, the order of magnitude of its length.  A
softmax layer on the average gives the score; vectors and layer are trained together
by stochastic gradient descent in numpy.

Training rows are a bounded sample: ``SAMPLE`` labelled documents at most, those with
the smallest hash of their doc_id, of the rows whose crc32(doc_id) modulo 5 is not 0.
Their features (hashed, so bounded per document) come to the driver; texts do not.
Nothing but the text enters a score.  As the output layer is linear, a bucket's share
in the score is one number, so documents are scored by a table of ``BUCKETS`` numbers.

Null texts are empty; an empty text has its length mark and is scored like any other.
Null labels are left out; a doc_id with both labels trains on each, and of several texts
under one doc_id the smallest is learned from.
Without labels of both kinds every score is 1.  Rows are kept as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Batch
from .common import fold, ids_and_texts, runs_of_rows
from .packed import pack, unpack
from .rolling import mix

FOLDS, HELD_OUT = 5, 0
BITS, WIDTH, GRAMS = 16, 8, (3, 4, 5)
BUCKETS = 1 << BITS
SAMPLE, EPOCHS, RATE, SEED = 4000, 5, 0.5, 11
CUTOFF = 0.3
#: Added before hashing, to keep kinds of features apart.
PAIR, AGAIN, BEFORE, SIZE = (np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in (101, 102, 103, 104))


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of (bucket, text) of all features of the texts."""
    b = Batch(texts)
    n = len(texts)
    yield buckets_of(b.words), b.text
    next_to = np.flatnonzero(b.text[1:] == b.text[:-1])
    yield buckets_of(mix(b.words[next_to] * np.uint64(3) + b.words[next_to + 1] + PAIR)), b.text[next_to]
    again = b.text[next_to][b.words[next_to] == b.words[next_to + 1]]
    yield np.full(len(again), int(buckets_of(mix(np.array([AGAIN])))[0]), np.int32), again
    long, of = b.shingles(5)
    order = np.lexsort((np.arange(len(of)), long, of))
    before = order[1:][(long[order][1:] == long[order][:-1]) & (of[order][1:] == of[order][:-1])]
    yield np.full(len(before), int(buckets_of(mix(np.array([BEFORE])))[0]), np.int32), of[before]
    size = np.array([int(k).bit_length() for k in b.per_text], np.uint64)
    yield buckets_of(mix(size + SIZE)), np.arange(n)
    end = b.begin[1:] - 1
    owner = np.repeat(np.arange(n), np.diff(b.begin))
    for k in GRAMS:
        hashes = b.ranges.of_every(k) if len(b.data) >= k else np.zeros(0, np.uint64)
        inside = np.flatnonzero(np.arange(len(hashes)) + k <= end[owner[: len(hashes)]])
        yield buckets_of(hashes[inside]), owner[inside]


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of one text and their counts."""
    total = np.zeros(BUCKETS, np.int64)
    for bucket, _ in features([text]):
        total += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    return some.astype(np.int32), total[some].astype(np.float32)


class Model:
    """Bucket vectors and a softmax layer of two classes."""

    def __init__(self, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.vectors = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        self.layer = np.zeros((WIDTH, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> None:
        draw, done, whole = np.random.default_rng(seed), 0, max(1, epochs * len(rows))
        for _ in range(epochs):
            for i in draw.permutation(len(rows)):
                bucket, count, label = rows[i]
                weight = count / count.sum()
                hidden = weight @ self.vectors[bucket]
                z = hidden @ self.layer + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                step = rate * (1 - done / whole)
                back = self.layer @ p
                self.layer -= step * np.outer(hidden, p)
                self.bias -= step * p
                self.vectors[bucket] -= np.outer(weight * (step * GAIN), back)
                done += 1

    def shares(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of class 1 (to be averaged), and the bias."""
        side = self.layer[:, 1] - self.layer[:, 0]
        return (self.vectors @ side).astype(np.float32), float(self.bias[1] - self.bias[0])


#: Vectors of an average get small gradients each; their steps are longer by this.
GAIN = 20.0


def train_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``quality``, or None if there are not labels of both kinds."""
    ids = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    ids = ids.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of_rows(batches):
            rows = [pack(*counted(t.encode())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "data"])

    joined = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most
    # of texts that share a doc_id the smallest is learned from
    joined = joined.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = sorted((r["doc_id"], r["label"], bytes(r["data"])) for r in joined.mapInArrow(run, "doc_id long, label int, data binary").collect())
    if len({label for _, label, _ in found}) < 2:
        return None
    model = Model()
    model.train([(*unpack(data), label) for _, label, data in found])
    return model


def score_texts(texts: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, of in features(texts):
        total += np.bincount(of, weights=table[bucket], minlength=len(texts))
        n += np.bincount(of, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / n + bias, -500, 500)))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train_model(docs, labels, sample)
    out = ids_and_texts(docs)
    if model is None:
        out = out.select("doc_id", F.lit(1.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model.shares())  # BUCKETS numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in runs_of_rows(batches, most=1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts([t.encode() for t in batch.column("text").to_pylist()], *shared.value))], ["doc_id", "score"])

        out = out.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
