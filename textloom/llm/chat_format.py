"""Chat formatting at the level of tokens.

A turn is ``<|turn|>`` role ``<|says|>`` text ``</s>``.  Role and text are encoded each
by itself, and the three marks are reserved ids put between them, so no text can make
a mark.  Control strings inside roles and texts are escaped before encoding, as is
what decoding would not give back, so that the formatted text can be read back too:
a backslash stands behind the first character of a control string, before a backslash,
and (with ``_``) for the space mark.  The loss mask covers the tokens of assistants'
texts; it is the running sum of +1 and -1 at the bounds of these segments.

Null roles and texts are empty.  Turns stand in order of ``turn`` (nulls first), ties
in order of their tokens; repeated rows are turns of their own.  Rows without conv_id
make one conversation.  Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs_of_rows
from .sentencepiece_codec import MARK, Codec, codec

TURN, SAYS, END = "<|turn|>", "<|says|>", "</s>"
CONTROLS = (TURN, SAYS, END, "<s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(["\\\\", MARK, *map(re.escape, CONTROLS)]))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    def one(m: re.Match) -> str:
        s = m[0]
        return "\\\\" if s == "\\" else "\\_" if s == MARK else f"{s[0]}\\{s[1:]}"

    return _ESCAPE.sub(one, text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: MARK if m[1] == "_" else m[1], text)


def reserved(c: Codec) -> dict[str, int]:
    """Ids of the marks: the model's own end, and two behind its last id."""
    return {TURN: len(c.pieces), SAYS: len(c.pieces) + 1, END: c.pieces.index(END)}


def assemble(c: Codec, role: str, text: str) -> tuple[list[int], np.ndarray]:
    """Ids and loss mask of one turn."""
    marks = reserved(c)
    segments = [[marks[TURN]], c.encode(escape(role)), [marks[SAYS]], c.encode(escape(text)), [marks[END]]]
    bound = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    step = np.zeros(bound[-1] + 1, np.int8)
    if role == "assistant":
        step[bound[3]] += 1
        step[bound[4]] -= 1
    return [i for s in segments for i in s], np.cumsum(step[:-1], dtype=np.int8)


def read_back(c: Codec, ids: list[int], mask: list[int]) -> tuple[str, str, str, int]:
    """Role, text, text under the mask, and characters of the formatted text of one turn."""
    marks = reserved(c)
    if ids[0] != marks[TURN] or ids[-1] != marks[END]:
        raise ValueError("not a turn")
    says = ids.index(marks[SAYS])
    role, text = c.decode(ids[1:says]), c.decode(ids[says + 1 : -1])
    learnt = c.decode([i for i, m in zip(ids, mask, strict=True) if m])
    return unescape(role), unescape(text), unescape(learnt), len(role) + len(text) + len(TURN) + len(SAYS) + len(END)


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, ids array<int>, loss array<tinyint>: one row per turn."""
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in runs_of_rows(batches):
            made = [assemble(c, r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([m.tolist() for _, m in made], pa.list_(pa.int8()))], ["conv_id", "turn", "ids", "loss"])

    return rows.mapInArrow(run, "conv_id long, turn long, ids array<int>, loss array<tinyint>")


def with_offsets(turns: DataFrame) -> DataFrame:
    """``turns`` with the offset of each in its conversation's tokens: the running sum of lengths."""
    before = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("offset", F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0)))


def conversation_digests(conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the tokens.

    A conversation is digested turn by turn as its rows go by, whatever its length.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, done = codec(path), None, []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return out

        def close() -> None:
            conv, n, turns, learnt, chars, formatted = now
            done.append((conv, n, turns.hexdigest(), chars, learnt.hexdigest(), formatted))

        for batch in batches:
            for conv, ids, loss in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "ids", "loss")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, text, learnt, n = read_back(c, ids, loss)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3].update(learnt.encode())
                now[4] += len(learnt)
                now[5] += n
            if done:
                yield rows()
        if now is not None:
            close()
            yield rows()

    turns = format_turns(conversations, path)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
