"""Alignment of two tokenizers over a corpus, worked out once for each distinct text.

Texts meet by their full content, so a text with many copies is tokenized once and
its counts weigh as much as its copies.  Distinct texts are handled in batches of
about ``BATCH`` bytes: a batch is written as one row with the measures of its texts,
its own table of linked id pairs, and for every text references into that table.
Only the batch's pairs, not those of every text, go through a shuffle: they are added
up to corpus-wide counts, the highest count of every id of A is found, and the answers
go back to their batches, where the measures of texts are completed.  These are joined
to documents by the text's SHA-256.

Two tokens are linked where their byte ranges overlap.  The ends of all tokens of
both sides cut the text into pieces, each inside one token of either side, and each
link is one such piece.

Texts that are null, empty, or not given back byte by byte by the tokens of both
sides have no tokens: zeros and an empty digest.  Documents keep their rows, repeated
or null doc_ids too; ties for an id's highest count all count as highest; an empty
table gives no rows.  Columns other than doc_id and text are not read.  A text is held
whole while it is tokenized.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage_folder
from .common import ids_and_texts, runs_of_rows
from .packed import pack, unpack

#: Bytes of distinct texts in a batch.
BATCH = 16_000_000
MARK = "▁"
#: How the byte-level pre-tokenizer of the tokenizers library splits texts (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_level(piece: str) -> bytes:
    """Bytes that a byte-level vocabulary entry stands for: printable Latin-1 as itself, the others from U+0100 on."""
    return bytes(_letters()[c] for c in piece)


@lru_cache(maxsize=1)
def _letters() -> dict[str, int]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library, special strings as plain text.

    tiktoken, several times as fast, does the work where both must agree: the merges are
    ranked as the entries are numbered, every entry comes out of merging its bytes, and the two
    put each character of the text into the same class (letter, number, space, other).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary = told["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in told["added_tokens"])]))
        for piece, i in vocabulary.items():
            self.bytes[i] = byte_level(piece)
        self.checked, self.apart = set(), set()
        self.fast = self._fast(told, vocabulary)

    def _fast(self, told: dict, vocabulary: dict[str, int]):
        import tiktoken

        before, merges = told["pre_tokenizer"] or {}, told["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ranked = [vocabulary.get(a + b) for a, b in pairs]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and told["normalizer"] is None
        if not plain or None in ranked or ranked != sorted(ranked) or len(vocabulary) != 256 + len(merges):
            return None
        ranks = {byte_level(p): i for p, i in vocabulary.items()}
        texts = [(t.decode(), i) for t, i in ranks.items() if _valid(t)]
        for (text, i), e in zip(texts, self.library.encode_batch([t for t, _ in texts], add_special_tokens=False), strict=True):
            if e.ids != [i] and len(self.library.pre_tokenizer.pre_tokenize_str(text)) == 1:
                return None
        self.classes = [tiktoken.Encoding(p, pat_str=p, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}) for p in (r"\p{L}", r"\p{N}", r"\s")]
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _same_class(self, c: str) -> bool:
        here = [bool(e.encode_ordinary(c)) for e in self.classes]
        there = [len(self.library.pre_tokenizer.pre_tokenize_str(x + c + x)) == 1 for x in "a1!"]
        return here == [there[0], there[1], not any(there)]

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            letters = set(text)
            for c in letters - self.checked:
                self.checked.add(c)
                if not self._same_class(c):
                    self.apart.add(c)
            if not self.apart & letters:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class Pieces:
    """A SentencePiece model; the bytes of each id's piece, space marks as spaces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.int64)


class Side:
    """Lengths and written forms of the ids of one side; the last id of a group has a form of its own."""

    def __init__(self, units: list[bytes], behind_last: str) -> None:
        self.units = units
        self.length = np.array([len(u) for u in units], np.int64)
        self.written = np.array([f"{i}," for i in range(len(units))] + [f"{i}{behind_last}" for i in range(len(units))], object)

    def joined(self, ids: np.ndarray) -> bytes:
        units = self.units
        return b"".join([units[i] for i in ids.tolist()])


class Aligner:
    """Both tokenizers of a task."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.left, self.right = Side(self.a.bytes, "|"), Side(self.b.bytes, ";")

    def align(self, text: str) -> tuple[int, int, int, int, bytes, np.ndarray, np.ndarray] | None:
        """n_a, n_b, n_groups, n_links, digest of the groups, linked pairs (a << 32 | b) and their occurrences; None without tokens."""
        a, b = self.a.encode(" " + text), self.b.encode(text)
        data = (" " + text).encode()
        if self.left.joined(a) != data or self.right.joined(b) != data:
            return None
        end_a, end_b = np.cumsum(self.left.length[a]), np.cumsum(self.right.length[b])
        ends = np.union1d(end_a, end_b)
        pairs, times = np.unique(a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)], return_counts=True)
        return len(a), len(b), len(a) + len(b) - len(ends), len(ends), self._groups(a, b, end_a, end_b), pairs, times

    def _groups(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> bytes:
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[of_a] == end_a, both[of_b] == end_b
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = self.left.written[a + len(self.left.units) * last_a]
        out[np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")] = self.right.written[b + len(self.right.units) * last_b]
        return hashlib.sha256("".join(out.tolist())[:-1].encode()).digest()


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _batch_row(found: list[tuple], copies: list[int], keys: list[bytes]) -> dict:
    """Measures of the texts, references to the batch's pairs, and these with the number of documents that hold them."""
    sizes = np.array([len(f[5]) for f in found], np.int64)
    pairs, at = np.unique(np.concatenate([f[5] for f in found]), return_inverse=True)
    docs = np.zeros(len(pairs), np.int64)
    np.add.at(docs, at, np.repeat(np.array(copies, np.int64), sizes))
    measures = np.array([f[:4] for f in found], np.int64).T
    return {
        "keys": b"".join(keys),
        "digests": b"".join(f[4] for f in found),
        "measures": pack(*measures, sizes),
        "links": pack(at.astype(np.uint32), np.concatenate([f[6] for f in found]).astype(np.uint32)),
        "pairs": pack(pairs, docs),
    }


def aligned_batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of batches of distinct texts, written beside the checkpoints."""
    fields = ("keys", "digests", "measures", "links", "pairs")
    arrow = pa.schema([(f, pa.binary()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        found, copies, keys, held = [], [], [], 0
        for batch in runs_of_rows(batches):
            for text, n in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                one = own.align(text)
                if one is None:
                    continue
                found.append(one)
                copies.append(n)
                keys.append(hashlib.sha256(text.encode()).digest())
                held += len(text)
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist([_batch_row(found, copies, keys)], arrow)
                    found, copies, keys, held = [], [], [], 0
        if found:
            yield pa.RecordBatch.from_pylist([_batch_row(found, copies, keys)], arrow)

    distinct = ids_and_texts(docs).where("text != ''").groupBy("text").agg(F.count("*").alias("copies"))
    path = f"{stage_folder(docs.sparkSession)}/batches"
    distinct.mapInArrow(run, ", ".join(f"{f} binary" for f in fields)).withColumn("batch", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def batch_pairs(batches: DataFrame) -> DataFrame:
    """batch, a, b, docs: the linked id pairs of each batch and how many documents hold them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, packed in zip(row.column("batch").to_pylist(), row.column("pairs"), strict=True):
                pairs, docs = unpack(packed.as_py())
                for i in range(0, len(pairs), 50_000):
                    part = pairs[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch)), pa.array((part >> 32).astype(np.int32)), pa.array((part & 0xFFFFFFFF).astype(np.int32)), pa.array(docs[i : i + 50_000])], ["batch", "a", "b", "docs"])

    return batches.select("batch", "pairs").mapInArrow(run, "batch long, a int, b int, docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (whether no pair of this a has more).

    An id of A has at most as many rows here as B has ids.
    """
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    return counts.select("a", "b", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))


def _completed(batch: pa.Table, answers: pa.Table) -> pa.Table:
    row = batch.to_pylist()[0]
    order = np.argsort(answers["a"].to_numpy().astype(np.int64) << 32 | answers["b"].to_numpy())
    n, best = answers["n"].to_numpy()[order], answers["best"].to_numpy(zero_copy_only=False)[order]
    *measures, sizes = unpack(row["measures"])
    at, times = unpack(row["links"])
    starts, times = np.cumsum(sizes) - sizes, times.astype(np.int64)
    sums = [np.add.reduceat(times * best[at], starts), np.add.reduceat(times * n[at], starts)]
    cut = lambda data: pa.array([data[i : i + 32] for i in range(0, len(data), 32)], pa.binary())
    return pa.table([cut(row["keys"]), *(pa.array(m) for m in [*measures, *sums]), cut(row["digests"])], ["key", *MEASURES, "digest"])


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    batches = aligned_batches(docs, path_a, path_b)
    pairs = batch_pairs(batches)
    answers = pairs.drop("docs").join(pair_counts(pairs), ["a", "b"])
    measured = batches.drop("pairs").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_completed, "key binary, " + "".join(f"{m} long, " for m in MEASURES) + "digest binary")
    # texts without content get keys of eight bytes, which spread and meet no digest
    key = F.when(F.col("text") == "", F.unhex(F.hex(F.xxhash64("doc_id")))).otherwise(F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    joined = ids_and_texts(docs).select("doc_id", key.alias("key")).join(measured, "key", "left")
    return joined.select("doc_id", *(F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in MEASURES), F.coalesce(F.lower(F.hex("digest")), F.lit("")).alias("groups_sha256"))


def linked_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, n, best of the whole corpus, for a table that maps ids of A to ids of B."""
    return pair_counts(batch_pairs(aligned_batches(docs, path_a, path_b)))
