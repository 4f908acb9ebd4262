"""SentencePiece encoding and decoding of whole texts by prefix tables.

Each text is one long string to the merges, but no piece holds a space mark behind
another character, so no merge crosses such a place, and characters outside the
vocabulary (the line feed among them) merge with nothing.  Texts are cut there and
each cut's encoding is remembered per task, up to a bound after which the memory
starts afresh; both leave the result unchanged.

Null and empty texts have no ids and decode to the empty text.  Rows are kept as
they come: repeated rows, null ids, and columns other than doc_id and text (which
are not read) make no difference.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Merges, PrefixTable, greedy
from .common import ids_and_texts, lean, runs_of_rows

MARK = "▁"
REMEMBERED = 300_000


class Codec:
    """The vocabulary of one BPE model with byte fallback and no text normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.fallback = {b: i for i, b in self.byte.items()}
        if len(self.fallback) != 256:
            raise ValueError("the model has no byte fallback")
        usual = [i for i in range(n) if i not in self.byte and i not in self.silent and i != self.unknown]
        self.ids = ids = {self.pieces[i]: i for i in usual}
        rank = [-1] * n
        for r, i in enumerate(sorted((i for i in usual if len(self.pieces[i]) > 1), key=lambda i: (-model.get_score(i), i))):
            rank[i] = r
        pieces = self.pieces

        def pair_rank(a: int, b: int) -> int | None:
            t = ids.get(pieces[a] + pieces[b])
            return None if t is None else rank[t]

        parts, strings = {}, {}
        for i in usual:
            piece = pieces[i]
            if all(c in ids for c in piece):
                tokens, merged = greedy([ids[c] for c in piece], pair_rank, lambda a, b: ids[pieces[a] + pieces[b]])
                if tokens == [i]:  # others never come out of merging
                    strings[piece] = i
                    if merged:
                        parts[i] = merged
        self.table = PrefixTable(strings, Merges(rank, parts, pair_rank))
        inside = any(re.search(f"[^{MARK}]{MARK}", p) for p in strings)
        line_feed = "" if "\n" in ids else "\n"
        self.cuts = re.compile(r"(?s).+" if inside else f"{MARK}*[^{MARK}{line_feed}]+|{MARK}+" + (f"|{line_feed}" if line_feed else ""))
        self.outside = re.compile("[^" + "".join(re.escape(c) for c in ids if len(c) == 1) + "]")
        self.known: dict[str, tuple[int, ...]] = {}
        probe = " the  end\né\U0001f642 (x)"
        if self.encode(probe) != model.encode(probe):
            raise ValueError("the model normalises texts or adds no leading space mark")

    def _encode_cut(self, cut: str) -> tuple[int, ...]:
        if not self.outside.search(cut):
            return tuple(self.table.encode(cut))
        out: list[int] = []
        start = 0
        for i, c in enumerate(cut):
            if c not in self.ids:
                out += self.table.encode(cut[start:i]) if i > start else []
                out += [self.fallback[b] for b in c.encode()]
                start = i + 1
        return tuple(out + self.table.encode(cut[start:]) if start < len(cut) else out)

    def cuts_of(self, text: str) -> list[str]:
        return self.cuts.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for cut in self.cuts_of(text):
            ids = known.get(cut)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self._encode_cut(cut)
                if len(cut) < 200:
                    known[cut] = ids
            out += ids
        return out

    def forget(self) -> None:
        """Leaves what the vocabulary gives alone; encodings of cuts and answers about pairs go."""
        self.known.clear()
        self.table.merges.known.clear()

    @property
    def bytes_of(self) -> list[bytes]:
        """UTF-8 of each id's piece, space marks as spaces."""
        table = self.__dict__.get("_bytes")
        if table is None:
            table = [b"" if i in self.silent else bytes([self.byte[i]]) if i in self.byte else " ⁇ ".encode() if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
            self._bytes = table
        return table

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: without the leading space that encoding puts in front."""
        table = self.bytes_of
        data = b"".join([table[i] for i in ids])
        head = next((i for i in ids if i not in self.silent), None)
        if head is not None and head not in self.byte and head != self.unknown and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def ids_of_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """A task of ``encode_ids``; the worker keeps the vocabulary alone."""
    c = codec(path)
    try:
        for batch in runs_of_rows(batches):
            texts = batch.column("text").to_pylist()
            ids = [c.encode(t) for t in texts]
            same = [c.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "lossless"])
    finally:
        c.forget()


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, lossless (decoding gave the text back)."""
    return ids_and_texts(docs).mapInArrow(lean(lambda batches: ids_of_batches(batches, path)), "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids joined by commas), decoded_sha256, lossless (decoding gave the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        numbers = [str(i) for i in range(len(c.pieces))]
        for batch in runs_of_rows(batches):
            rows: tuple[list, ...] = ([], [], [], [])
            for text in batch.column("text").to_pylist():
                ids = c.encode(text)
                decoded = c.decode(ids)
                for row, value in zip(rows, (len(ids), hashlib.sha256(",".join([numbers[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text), strict=True):
                    row.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
