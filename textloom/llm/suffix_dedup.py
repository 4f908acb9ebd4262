"""Removal of text that already stands in an earlier document.

A byte goes if some string of ``length`` bytes (50) that covers it also starts in a
document with a smaller doc_id.  That is what the longest-previous-factor array of
the whole corpus says: sort all suffixes; of a suffix, the longest match that starts
earlier is with its previous or its next smaller position in suffix order.

Equal strings of 50 bytes have equal anchors (the substring of 20 bytes with the
smallest hash in them), so suffixes need to be compared only under a shared anchor.

1. Each document's windows are put under their anchors: about one anchor for 15
   bytes, with hashes of the anchor and of the stretch its windows span.  Of equal
   stretches in one batch only those of the smallest doc_id travel on.
2. By anchor, equal stretches of greater doc_ids are removed.  What is left under an
   anchor with different stretches are the ends of matches; their bytes are fetched.
3. By anchor again, the suffixes of these stretches are sorted and compared byte by
   byte; the previous and the next smaller doc_id in suffix order give each suffix its
   longest previous factor, and the windows where that has 50 bytes are removed.

No task needs a whole anchor.  Where more than WIDE different stretches stand under
one, their windows meet by hash instead (48 bits of the anchor, 64 of the window),
one row of a window and batch, in sorted rows that are read as a stream.  A bucket of
more than FULL stretches is not settled in memory either: its rows meet by stretch in
the same way, and anchors with different stretches are found by aggregates.

Anchors are dealt by hash and combined per batch first, so a passage that stands in
very many documents costs each batch one row.

Null texts are empty; texts under 50 bytes stay.  Rows without doc_id are neither
removed from nor matched.  Matches inside one document do not count, and repeated
rows keep their text.  doc_id names a text: where rows share it but not the text,
spans found in any of them are cut from all, as far as these reach.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import with_bitmap
from .common import checkpointed, ids_and_texts, lean, pieces_for, runs_of_rows, text_bytes
from .packed import pack, rows_in, unpack_all
from .rolling import RangeHashes

LENGTH = 50
ANCHOR = 20
#: Longer texts are hashed in pieces that overlap by a window.
PIECE = 250_000
#: Text bytes whose anchors are combined before they travel, and those behind one bucket.
BATCH, BUCKET = 12_000_000, 5_000_000
#: Different stretches of one anchor that are compared in one task, and stretches of one bucket that are held at once.
WIDE, FULL = 20_000, 2_000_000
#: A task goes through many buckets one after another.
MOST_BUCKETS, MOST_PARTS = 1 << 22, 8192
BITS = 24
POSITION = np.uint64((1 << BITS) - 1)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of pieces of about PIECE bytes: text number, offset, bytes."""
    number, offset, part, size = [], [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), PIECE):
            number.append(i)
            offset.append(start)
            part.append(text[start : start + PIECE + length - 1])
            size += len(part[-1])
            if size >= PIECE:
                yield number, offset, part
                number, offset, part, size = [], [], [], 0
    if part:
        yield number, offset, part


def anchors(texts: list[bytes], length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, first and last window start, anchor hash and stretch hash of each stretch of windows with one anchor."""
    per_window = length - anchor + 1
    for number, offset, parts in pieces(texts, length):
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(parts), np.uint8)
        if len(data) < length:
            continue
        hashes = RangeHashes(data)
        grams = hashes.of_every(anchor)
        least = grams & ~POSITION | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the leftmost
        reach = 1
        while 2 * reach <= per_window:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if rest := per_window - reach:
            least = np.minimum(least[:-rest], least[rest:])
        where = (least & POSITION).astype(np.int64)
        windows = np.flatnonzero(np.repeat(ends, sizes)[: len(where)] - np.arange(len(where)) >= length)
        if not len(windows):
            continue
        at = where[windows]
        new = np.flatnonzero((np.diff(at) != 0) | (np.diff(windows) != 1)) + 1
        first = windows[np.concatenate([[0], new])]
        last = windows[np.concatenate([new - 1, [len(windows) - 1]])]
        at = at[np.concatenate([[0], new])]
        stretch = hashes.of(first, last + length) ^ ((at - first) * 64 + (last - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        piece = np.searchsorted(ends, first, side="right")
        shift = np.array(offset)[piece] - np.concatenate([[0], ends[:-1]])[piece]
        yield np.array(number)[piece], first + shift, last + shift, grams[at] >> np.uint64(16), stretch & np.uint64((1 << 40) - 1)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any key."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def first_of_run(head: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.flatnonzero(head)[np.cumsum(head) - 1]]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts one behind another; the list is empty then."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors have the smallest hashes of their windows, so these are mixed before they are dealt."""
    return ((gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def stretches(batches: Iterator[pa.RecordBatch], buckets: int, length: int, anchor: int) -> Iterator[tuple[int, bytes]]:
    """Packed stretches by bucket; what the batch itself shows to be removed has bucket -1."""
    found, size = tuple([] for _ in range(5)), 0

    def flush() -> Iterator[tuple[int, bytes]]:
        # one column at a time, so that no second copy of all of them is held
        columns = [joined(parts) for parts in found]

        def put_in(order: np.ndarray) -> None:
            for i, c in enumerate(columns):
                columns[i] = c[order]

        ids, _, _, gram, stretch = columns
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort((gram << np.uint64(16) ^ stretch)[order], kind="stable")]
        del ids, gram, stretch
        put_in(order)
        ids, start, n, gram, stretch = columns
        gone = first_of_run(heads(gram, stretch), ids) < ids
        if gone.any():
            first = start[gone].astype(np.int64)
            yield -1, pack(ids[gone], first, first + n[gone] + length)
        order = np.flatnonzero(~gone)
        order = order[np.argsort(bucket_of(gram[order], buckets), kind="stable")]
        del ids, start, n, gram, stretch, gone
        put_in(order)
        del order
        bucket = bucket_of(columns[3], buckets)
        cut = np.append(np.flatnonzero(heads(bucket)), len(bucket))
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(bucket[a]), pack(*(c[a:z] for c in columns))

    for batch in runs_of_rows(batches):
        keep = batch.column("doc_id").is_valid()
        batch = batch.filter(keep)
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        ids = batch.column("doc_id").to_numpy()
        size += sum(map(len, texts))
        for number, start, last, gram, stretch in anchors(texts, length, anchor):
            for parts, c in zip(found, (ids[number], start.astype(np.uint32), (last - start).astype(np.uint8), gram, stretch), strict=True):
                parts.append(c)
        if size >= BATCH and found[0]:
            yield from flush()
            size = 0
    if found[0]:
        yield from flush()


def settle(blobs: list[bytes], length: int, wide: int = WIDE) -> Iterator[tuple[str, bytes]]:
    """Of one bucket: packed spans to remove, and the stretches whose bytes (under wide anchors: windows) are needed."""
    ids, start, n, gram, stretch = unpack_all(blobs)
    order = np.argsort(gram, kind="stable")
    head = heads(gram[order])
    size = np.diff(np.append(np.flatnonzero(head), len(head)))
    order = order[np.repeat(size > 1, size)]  # anchors that stand once are done
    order = order[np.lexsort((ids[order], stretch[order], gram[order]))]
    ids, start, stop, gram, stretch = ids[order], start[order].astype(np.int64), start[order] + n[order].astype(np.int64) + length, gram[order], stretch[order]
    if not len(ids):
        return
    head = heads(gram, stretch)
    least = first_of_run(head, ids)
    gone = ids > least
    if gone.any():
        yield "remove", pack(ids[gone], start[gone], stop[gone])
    group = heads(gram)
    at = np.flatnonzero(group)
    mixed = (np.minimum.reduceat(least, at) < np.maximum.reduceat(least, at))[np.cumsum(group) - 1] & ~gone
    large = (np.add.reduceat((~gone).astype(np.int64), at) > wide)[np.cumsum(group) - 1]
    for kind, rows in ("compare", mixed & ~large), ("windows", mixed & large):
        if rows.any():
            yield kind, pack(ids[rows], start[rows], stop[rows], gram[rows])


def settled(rows: Iterator[tuple[int, bytes]], length: int, wide: int, full: int) -> Iterator[tuple[str, bytes]]:
    """``settle`` for each bucket of rows sorted by bucket; stretches of a bucket with more than ``full`` come as they are."""
    now, held, n = None, [], 0
    for bucket, data in rows:
        if bucket < 0:
            yield "remove", data
            continue
        if bucket != now:
            if held:
                yield from settle(held, length, wide)
            now, held, n = bucket, [], 0
        held.append(data)
        n += rows_in(data)
        if n > full:
            yield from (("later", b) for b in held)
            held = []
    if held:
        yield from settle(held, length, wide)


def with_least(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (longs, doc_id among them) and ``least``, the smallest doc_id of equal keys."""
    schema = f"{', '.join(f'{c} long' for c in rows.columns)}, least long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            ids = batch.column("doc_id").to_numpy()
            head = heads(*columns)
            found = first_of_run(head, ids).copy()
            if last == [c[0] for c in columns]:  # the run goes on from the batch before
                found[: np.append(np.flatnonzero(head), len(head))[1]] = least
            last, least = [c[-1] for c in columns], found[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "least"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(run, schema)


def windows_of(ids: np.ndarray, start: np.ndarray, gram: np.ndarray, texts: list[bytes], length: int) -> list[np.ndarray]:
    """doc_id, first and last start, anchor, hash and smallest doc_id here of the windows of these stretches.

    Rows of greater doc_ids are to be removed; consecutive windows with one hash are one row.
    """
    size = np.array([len(t) for t in texts])
    windows = size - length + 1
    number = np.repeat(np.arange(len(ids)), windows)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(size) - size)[number] + offset
    value = RangeHashes(np.frombuffer(b"".join(texts), np.uint8)).of(at, at + length)
    ids, start, gram = ids[number], start[number] + offset, gram[number]
    order = np.lexsort((start, ids, value, gram))
    ids, start, gram, value = ids[order], start[order], gram[order], value[order].view(np.int64)
    least = first_of_run(heads(gram, value), ids)
    head = heads(gram, value, ids)
    head[1:] |= np.diff(start) > 1
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(head)) - 1
    return [ids[first], start[first], start[last], gram[first], value[first], least[first]]


def common_prefixes(rows: np.ndarray, left: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before; 0 where a group begins.  ``left``: bytes each row has."""
    out = np.zeros(len(rows), np.int64)
    same = rows[1:] == rows[:-1]
    equal = np.where(same.all(1), rows.shape[1], same.argmin(1))
    out[1:] = np.where(group[1:], 0, np.minimum(equal, np.minimum(left[1:], left[:-1])))
    return out


def match_with_smaller(doc: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """For each row in suffix order, the bytes shared with the nearest previous row of a smaller doc_id.

    ``shared``: bytes shared with the row before.  Rows point at the row before and jump on
    along the pointers of rows that are not smaller; where under ``length`` bytes are left
    the search ends with 0.
    """
    at, most = np.arange(-1, len(doc) - 1), shared.copy()
    todo = np.arange(len(doc))
    while True:
        todo = todo[most[todo] >= length]
        todo = todo[doc[at[todo]] >= doc[todo]]
        if not len(todo):
            break
        over = at[todo]
        most[todo], at[todo] = np.minimum(most[todo], most[over]), at[over]
    return np.where(most >= length, most, 0)


def previous_factors(ids: np.ndarray, gram: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch number, offset and longest previous factor of each window.

    Suffixes (from a window's start to the end of its stretch) are sorted under each
    anchor.  The longest match with a smaller doc_id is with the previous or with the
    next smaller one in this order.  Matches of under ``length`` bytes count as 0.
    """
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    windows = size - length + 1
    number = np.repeat(np.arange(len(ids)), windows)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(windows) - windows, windows)
    left = size[number] - offset
    width = -(-int(size.max()) // 8) * 8
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[begin[number] + offset]
    rows[np.arange(width) >= left[:, None]] = 0
    doc = ids[number]
    order = np.lexsort((doc, *rows.view(">u8").astype(np.uint64).T[::-1], gram[number]))
    rows = rows[order]
    doc, shared = doc[order], common_prefixes(rows, left[order], heads(gram[number][order]))
    del rows
    before = match_with_smaller(doc, shared, length)
    after = match_with_smaller(doc[::-1], np.append(0, shared[:0:-1]), length)[::-1]
    return number[order], offset[order], np.maximum(before, after)


def merged(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each doc_id with those joined that touch or overlap."""
    order = np.lexsort((first, ids))
    ids, first, last = ids[order], first[order], last[order]
    start = np.flatnonzero(heads(ids))
    reach = np.concatenate([np.maximum.accumulate(part) for part in np.split(last, start[1:])]) if len(last) else last
    new = heads(ids)
    new[1:] |= first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ids[at], first[at], reach[np.append(at[1:], len(reach)) - 1]


def compare(blobs: list[bytes], bytes_of: list[bytes], length: int) -> Iterator[bytes]:
    ids, start, size, gram = unpack_all(blobs)
    size = size.astype(np.int64)
    data = np.frombuffer(b"".join(bytes_of), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(gram, kind="stable")
    cuts = np.append(np.flatnonzero(heads(gram[order])), len(order))
    at = 0
    while at < len(cuts) - 1:  # some thousands of stretches at a time, whole anchors each
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + 20_000, side="right")) - 1)
        part = order[cuts[at] : cuts[to]]
        where = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(size[part])[:-1]]), size[part]) + np.arange(size[part].sum())
        number, offset, factor = previous_factors(ids[part], gram[part], size[part], data[where], length)
        number, offset = number[factor >= length], offset[factor >= length]
        if len(number):
            first = start[part][number] + offset
            yield pack(*merged(ids[part][number], first, first + length))
        at = to


def by_bucket(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The binary values of each bucket of a partition sorted by bucket."""
    bucket, held = None, [[] for _ in columns]
    for batch in batches:
        for row in zip(batch.column("bucket").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != bucket:
                if held[0]:
                    yield bucket, held
                bucket, held = row[0], [[] for _ in columns]
            for h, value in zip(held, row[1:], strict=True):
                h.append(value)
    if held[0]:
        yield bucket, held


def binary_rows(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, wide: int = WIDE, full: int = FULL) -> DataFrame:
    """doc_id, start, stop: byte spans that cover exactly what is to be removed; they may overlap.

    ``docs``: doc_id long, text string, and columns that the caller joins the spans to.
    Texts are joined in the caller's form, so that both joins share one shuffle.
    """
    whole, docs = docs, ids_and_texts(docs)
    buckets = min(pieces_for(text_bytes(docs), BUCKET), MOST_BUCKETS)
    parts = min(buckets, MOST_PARTS)
    keyed = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])
    kinds = pa.schema([("kind", pa.string()), ("data", pa.binary())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return binary_rows(stretches(batches, buckets, length, anchor), keyed)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True))
        return binary_rows(settled(rows, length, wide, full), kinds)

    placed = docs.mapInArrow(lean(put), "bucket long, data binary")
    spread = F.when(F.col("bucket") < 0, F.abs(F.xxhash64("data")) % buckets).otherwise(F.col("bucket"))
    met = checkpointed(placed.repartition(parts, spread).sortWithinPartitions("bucket").mapInArrow(meet, "kind string, data binary"))

    def expand(columns: list[str]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in unpack_all([data])], columns)

        return run

    removed = met.where("kind = 'remove'").select("data").mapInArrow(expand(["doc_id", "start", "stop"]), "doc_id long, start long, stop long")
    wanted = met.where("kind = 'compare'").select("data").mapInArrow(expand(["doc_id", "start", "stop", "gram"]), "doc_id long, start long, stop long, gram long")
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "gram")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in runs_of_rows(batches, most=8_000_000):
                want = batch.column("wanted")
                batch = batch.filter(want.is_valid())
                if not batch.num_rows:
                    continue
                want = batch.column("wanted")
                row = np.repeat(np.arange(batch.num_rows), want.value_lengths().to_numpy(zero_copy_only=False))
                start, stop, gram = (want.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
                texts = [t.encode() for t in batch.column("text").to_pylist()]
                part = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
                size = np.array([len(p) for p in part], np.int32)
                bucket = bucket_of(gram.astype(np.uint64), buckets)
                ids, order = batch.column("doc_id").to_numpy(), np.argsort(bucket, kind="stable")
                order = order[size[order] >= length]
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                    yield int(bucket[own[0]]), pack(ids[row[own]], start[own], size[own], gram[own]), b"".join([part[i] for i in own.tolist()])

        return binary_rows(rows(), pa.schema([*keyed, ("bytes", pa.binary())]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (blobs, parts) in by_bucket(batches, "data", "bytes"):
            for data in compare(blobs, parts, length):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpack_all([data])], ["doc_id", "start", "stop"])

    fetched = whole.join(wanted, "doc_id", "left").mapInArrow(lean(fetch), "bucket long, data binary, bytes binary")
    matched = fetched.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(match), "doc_id long, start long, stop long")
    out = removed.unionByName(matched)

    seen = {r["kind"] for r in met.select("kind").distinct().collect()}
    held = met.where("kind = 'windows'").select("data").mapInArrow(expand(["doc_id", "start", "stop", "gram"]), "doc_id long, start long, stop long, gram long")
    if "later" in seen:
        later = met.where("kind = 'later'").select("data").mapInArrow(expand(["doc_id", "start", "n", "gram", "stretch"]), "doc_id long, start long, n long, gram long, stretch long")
        later = checkpointed(with_least(later, "gram", "stretch").withColumn("stop", F.col("start") + F.col("n") + length))
        out = out.unionByName(later.where("doc_id > least").select("doc_id", "start", "stop"))
        mixed = later.groupBy("gram").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high").select("gram")
        held = held.unionByName(later.where("doc_id = least").join(mixed, "gram", "left_semi").select("doc_id", "start", "stop", "gram"))
    if not seen & {"windows", "later"}:
        return out

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of_rows(batches):
            want = batch.column("held")
            row = np.repeat(np.arange(batch.num_rows), want.value_lengths().to_numpy(zero_copy_only=False))
            start, stop, gram = (want.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            part = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
            there = np.flatnonzero(np.array([len(p) for p in part]) >= length)
            if len(there):
                ids = batch.column("doc_id").to_numpy()[row]
                found = windows_of(ids[there], start[there], gram[there], [part[i] for i in there.tolist()], length)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["doc_id", "start", "last", "gram", "window", "here"])

    by_doc = held.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "gram")).alias("held"))
    by_doc = checkpointed(by_doc)
    spread_out = with_bitmap(docs, by_doc.select("doc_id")).where("maybe").drop("maybe").join(by_doc, "doc_id").mapInArrow(lean(unfold), "doc_id long, start long, last long, gram long, window long, here long")
    spread_out = checkpointed(spread_out)
    span = ["doc_id", "start", (F.col("last") + length).alias("stop")]
    out = out.unionByName(spread_out.where("doc_id > here").select(*span))
    return out.unionByName(with_least(spread_out.where("doc_id = here").drop("here"), "gram", "window").where("doc_id > least").select(*span))


def covered(spans: pa.Array, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each text, which of its bytes some span covers."""
    for span, size in zip(spans, sizes, strict=True):
        step = np.zeros(size + 1, np.int32)
        if span.is_valid and size:
            start, stop = (span.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(step, np.minimum(start, size), 1)
            np.add.at(step, np.minimum(stop, size), -1)
        yield np.cumsum(step[:-1]) > 0


def with_spans(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    spans = repeated_spans(docs, length, anchor).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(spans, "doc_id", "left")


def repeat_digests(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of_rows(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            removed, spans, digest = [], [], []
            for text, gone in zip(texts, covered(batch.column("spans"), list(map(len, texts))), strict=True):
                n = int(gone.sum())
                removed.append(n)
                spans.append(int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()))
                digest.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = with_spans(ids_and_texts(docs), length, anchor)
    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated spans cut from ``text`` and ``n_chars`` (where there is one) counted anew.

    A character goes only if all of its bytes go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of_rows(batches):
            out = []
            texts = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            for text, gone in zip(texts, covered(batch.column("spans"), [len(t or b"") for t in texts]), strict=True):
                if text and gone.any():
                    data = np.frombuffer(text, np.uint8)
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    whole = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
                    text = data[~whole].tobytes()
                out.append(None if text is None else text.decode())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string())).drop_columns(["spans"])

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest") if rest else F.lit(0).alias("rest"))
    out = with_spans(rows, length, anchor).mapInArrow(lean(run), rows.schema)
    out = out.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
