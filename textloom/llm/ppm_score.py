"""Language-model scores of documents: prediction by partial matching over bytes.

The model is a trie of byte contexts, up to four bytes long, with the counts of the
byte that follows each in the training documents.  A byte is predicted by the longest
context that has it: each longer context that lacks it gives up its escape
probability (method C: different followers / (count + different followers)), and
bytes that a longer context has are excluded from the shorter ones.  At the bottom all
256 values are equally likely.  A text is its bytes and one end mark (0xFF, which
UTF-8 never uses); before it stand four zeros.

The deep levels of the model are never in one place.  Documents are dealt into shards
by hash; each shard reports the five-byte strings and words it has, with their counts in
training documents; these meet by the last three bytes of the context (strings) and by
hash (words), where probabilities and totals are worked out, and go back to the shards
that asked for them.  Each shard names a string once, so a common context costs a
bucket at most 2 ** 16 strings a shard.  The shallow levels, up to two bytes of context,
are counts of at most 2 ** 24 three-byte strings whatever the size of the corpus; these
alone go to every task.

Beside it stands a base score, the add-one unigram score of lower-cased words.  Words
are told apart by 64-bit hashes.

Null texts are empty: one token, the end.  Rows are kept as they come; null ids count
as training documents by the hash of the empty text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Batch
from .common import checkpointed, fold, ids_and_texts, pieces_for, runs_of_rows, text_bytes
from .packed import pack, unpack, unpack_all

FOLDS, HELD_OUT = 7, 2
ORDER, END = 4, 0xFF
#: Text bytes of a shard, of a bucket, and of a step in a shard.
SHARD, BUCKET, STEP = 24_000_000, 6_000_000, 1_000_000
END_TOKEN = np.uint64(0xE0E0E0E0E0E0E0E0)


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (and end) of the texts behind its context, as one number; and where each text's begin."""
    head, tail = bytes(ORDER), bytes([END])
    data = np.frombuffer(b"".join([head + t + tail for t in texts]), np.uint8)
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        out = out << np.uint64(8) | data[k : len(data) - ORDER + k]
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    keep = np.ones(len(out), bool)
    gap = (begin + np.arange(len(texts)) * ORDER)[1:]
    keep[(gap[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    return out[keep], begin


def tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(count[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def steps(texts: list[bytes], ids: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts in runs of about STEP bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP:
            yield texts[start : i + 1], ids[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:], ids[start:]


class Levels:
    """Counts of symbols after contexts of one length, and what is left of them under exclusion."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.contexts, at = np.unique(keys >> np.uint64(8), return_index=True)
        self.total = np.add.reduceat(counts, at) if len(at) else np.zeros(0, np.int64)
        self.kinds = np.diff(np.append(at, len(keys)))

    def count(self, keys: np.ndarray) -> np.ndarray:
        return look(self.keys, self.counts, keys)

    def context(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return look(self.contexts, self.total, contexts), look(self.contexts, self.kinds, contexts)


def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at ``wanted`` in sorted ``keys``, 0 where absent."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.dtype.type(0))


def low(keys: np.ndarray, n_bytes: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * n_bytes) - 1)


def shallow_levels(triples: tuple[np.ndarray, np.ndarray]) -> dict[int, Levels]:
    """Levels 2 to 0 from the counts of three-byte strings."""
    levels = {2: Levels(*triples)}
    for o in (1, 0):
        above = levels[o + 1]
        levels[o] = Levels(*tally([low(above.keys, o + 1)], [above.counts]))
    return levels


def log_probabilities(keys: np.ndarray, counts: np.ndarray, shallow: dict[int, Levels]) -> np.ndarray:
    """log10 of each symbol's probability in its context.

    keys: sorted five-byte strings; every training string that shares the last three
    context bytes with one of them is among them.  counts: in training.
    """
    # levels[o]: strings of o context bytes and a symbol
    seen = counts > 0
    levels = {ORDER: Levels(keys[seen], counts[seen])}
    for o in range(ORDER - 1, 2, -1):
        above = levels[o + 1]
        levels[o] = Levels(*tally([low(above.keys, o + 1)], [above.counts]))
    levels |= shallow
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))
    for o in range(ORDER, -1, -1):
        level, own = levels[o], low(keys[todo], o + 1)
        total, kinds = level.context(own >> np.uint64(8))
        if o < ORDER:
            # what the context one byte longer has is excluded here
            above = levels[o + 1]
            both = level.count(low(above.keys, o + 1))
            at = np.flatnonzero(np.concatenate([[True], np.diff(above.keys >> np.uint64(8)) != 0])) if len(above.keys) else np.zeros(0, np.int64)
            gone = np.add.reduceat(both, at) if len(at) else np.zeros(0, np.int64)
            context = low(keys[todo], o + 2) >> np.uint64(8)
            total = total - look(above.contexts, gone, context)
            kinds = kinds - look(above.contexts, above.kinds, context)
        count = level.count(own)
        here, weight = count > 0, (total + kinds).astype(float)
        out[todo[here]] += np.log10(count[here] / weight[here])
        escape = ~here & (kinds > 0)
        out[todo[escape]] += np.log10(kinds[escape] / weight[escape])
        todo = todo[~here]
    return out - np.where(np.isin(np.arange(len(keys)), todo), np.log10(max(1, 256 - len(levels[0].keys))), 0)


def triple_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings of two bytes (0 before the first) and the next, and their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of_rows(batches):
            found, count = np.unique(codes([t.encode() for t in batch.column("text").to_pylist()])[0] & np.uint64(0xFFFFFF), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(count)], ["triple", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), strict=True)]
        if columns:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*columns)], pa.binary())], ["data"])

    counts = train.mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    rows = counts.repartition(16, "triple").mapInArrow(packed, "data binary").collect()  # 2 ** 24 counts at most
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = unpack_all([r["data"] for r in rows])
    order = np.argsort(key)
    return key[order].astype(np.uint64), count[order]


def split_by(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed rows of each part; rows of a part stay in order."""
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        yield int(part[own[0]]), pack(*(c[own] for c in columns))


def shards_of(docs: DataFrame, shards: int) -> DataFrame:
    """shard, data: documents of a batch that fall to one shard, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in runs_of_rows(batches, most=24_000_000):
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            rows = []
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                sink = pa.BufferOutputStream()
                part = batch.select(["doc_id", "held_out", "text"]).take(pa.array(own))
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                rows.append((int(shard[own[0]]), zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["shard", "data"])

    placed = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    return placed.mapInArrow(run, "shard long, data binary")


def documents_in(data: bytes) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    import zstandard

    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()
    return table.column("doc_id").combine_chunks(), table.column("held_out").to_numpy(), [t.encode() for t in table.column("text").to_pylist()]


def reports(blobs: list[bytes], shard: int, buckets: int) -> Iterator[tuple[int, int, str, bytes]]:
    """bucket, shard, kind, data: the words and five-byte strings of a shard with their training counts."""
    words, grams = ([], []), ([], [])
    for blob in blobs:
        _, held, texts = documents_in(blob)
        for part, out in steps(texts, held):
            batch = Batch([t.lower() for t in part])
            train = ~out
            learnt = train[batch.text].astype(np.int64)
            ends = np.array([END_TOKEN])
            for store, found in ((words, (np.append(batch.words, ends), np.append(learnt, train.sum()))), (grams, (codes(part)[0], np.repeat(train.astype(np.int64), [len(t) + 1 for t in part])))):
                for column, values in zip(store, tally([found[0]], [found[1]]), strict=True):
                    column.append(values)
        words, grams = (tuple([x] for x in tally(*s)) for s in (words, grams))
    (w,), (n,) = words
    for bucket, data in split_by((w % np.uint64(buckets)).astype(np.int64), w, n.astype(np.uint32)):
        yield bucket, shard, "words", data
    (g,), (n,) = grams
    context = (g >> np.uint64(8) & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    for bucket, data in split_by((context % np.uint64(buckets)).astype(np.int64), g, n.astype(np.uint32)):
        yield bucket, shard, "strings", data


def answers(rows: list[tuple[int, str, bytes]], triples: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, str, bytes]]:
    """Of one bucket: shard, kind, data with totals or probabilities; shard -1 has token and word numbers."""
    for kind in ("words", "strings"):
        own = [(shard, unpack(data)) for shard, k, data in rows if k == kind]
        if not own:
            continue
        keys, counts = tally([c[0] for _, c in own], [c[1] for _, c in own])
        if kind == "words":
            yield -1, "numbers", pack(np.array([counts.sum()]), np.array([(counts > 0).sum()]))
            values = counts
        else:
            values = log_probabilities(keys, counts, shallow_levels(triples)).astype(np.float32)
        for shard, (wanted, _) in own:
            yield shard, kind, pack(wanted, values[np.searchsorted(keys, wanted)])


def scores(blobs: list[bytes], known: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, n_tokens, n_known, log_counts, score of a shard's documents."""
    tables = {}
    for kind in ("words", "strings"):
        key, value = unpack_all([data for k, data in known if k == kind])
        order = np.argsort(key)
        tables[kind] = key[order], value[order]
    (word, count), (gram, value) = tables["words"], tables["strings"]
    logs, end = np.log10(count + 1.0), count[np.searchsorted(word, END_TOKEN)]
    for blob in blobs:
        ids, held, texts = documents_in(blob)
        at = 0
        for part, out in steps(texts, held):
            batch = Batch([t.lower() for t in part])
            place = np.searchsorted(word, batch.words)
            n = len(part)
            has = np.bincount(batch.text, weights=count[place] > 0, minlength=n).astype(np.int64) + int(end > 0)
            total = np.bincount(batch.text, weights=logs[place], minlength=n) + np.log10(end + 1.0)
            found, begin = codes(part)
            score = np.add.reduceat(value[np.searchsorted(gram, found)].astype(float), begin)
            yield pa.RecordBatch.from_arrays([ids[at : at + n], pa.array(out, pa.bool_()), pa.array(batch.per_text + 1), pa.array(has), pa.array(total), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"])
            at += n


def score_documents(docs: DataFrame, shard_bytes: int = SHARD, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = ids_and_texts(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    size = text_bytes(docs)
    shards, buckets = pieces_for(size, shard_bytes), pieces_for(size, bucket_bytes)
    triples = docs.sparkSession.sparkContext.broadcast(triple_counts(docs.where(~F.col("held_out"))))
    dealt = shards_of(docs, shards)

    def report(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [d for b in batches for d in b.column("data").to_pylist()]
        for row in reports(blobs, key[0].as_py(), buckets):
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["bucket", "shard", "kind", "data"])

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "data")), strict=True)]
        for row in answers(rows, triples.value):
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["shard", "kind", "data"])

    said = dealt.groupBy("shard").applyInArrow(report, "bucket long, shard long, kind string, data binary")
    told = checkpointed(said.groupBy("bucket").applyInArrow(answer, "shard long, kind string, data binary"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[int(x[0]) for x in unpack(d)] for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], ["tokens", "words"])

    numbers = told.where("shard = -1").select("data").mapInArrow(read, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, words = (n or 0 for n in numbers)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = list(zip(right.column("kind").to_pylist(), right.column("data").to_pylist(), strict=True))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64())])
        return pa.Table.from_batches(scores(left.column("data").to_pylist(), known) if left.num_rows else [], schema)

    scored = dealt.groupBy("shard").cogroup(told.where("shard >= 0").groupBy("shard")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(tokens + words + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
