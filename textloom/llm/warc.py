"""WARC archives: one gzip member a record, written and read by Spark.

Writing gives every page a record.  Of pages with the same payload of ``LEAST``
bytes or more the one with the smallest page_id is a response and the others are
revisits that name it; all smaller payloads are responses.  Records of one file
stand behind one another, each in a gzip member of its own, so that any of them can
be read from its offset alone.  The files go through Spark's own writer, whose commit
leaves one copy of each task's file on any file system, whatever executors are lost.

Reading goes through a file member by member: deflated bytes are fed in bounded
steps, header lines end at the blank line, the block has the length that
Content-Length states, and digests of block and payload are worked out as the bytes
pass.  Only a payload that is asked for is held as a whole.

Null html: empty payload.  Null page_id: a response that nothing revisits, with a
record id of no page.  Rows that repeat the smallest page_id of their payload are the
same response again.  Equal payloads under one page_id that is not the smallest are
revisits each.  Control characters and spaces of a url are percent-encoded, a null
url leaves the header out.  An empty table gives no files' rows.  Columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_for, runs_of_rows

#: Payloads of fewer bytes are never revisited.
LEAST = 100
#: Bytes of payload for each file.
FILE_BYTES = 64_000_000
#: Bytes that are inflated at a time.
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD = "urn:page:"
FIELDS = "record_type string, record_id string, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, digest_ok boolean"


def with_roles(pages: DataFrame, files: int | None = None) -> DataFrame:
    """page_id, url, payload (binary), refers_to (the response's page_id for revisits, else null).

    Roles are joined by page and digest, so a payload that a third of all pages share
    spreads its pages like any other; the digest rows alone meet under one key.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    given = given.withColumn("digest", F.sha2("payload", 256))
    narrow = given.where(F.octet_length("payload") >= LEAST).where("page_id IS NOT NULL").select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).where("refers_to < _last").drop("_last")
    revisits = narrow.distinct().join(first, "digest").where("page_id > refers_to")
    if files:
        given = given.repartition(files, "page_id", "digest")
    return given.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))])
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([deflate.compress(f"WARC/1.1\r\n{head}\r\n".encode()), deflate.compress(block), deflate.compress(b"\r\n\r\n"), deflate.flush()])


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


def _page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{RECORD}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD}{refers_to}>")]
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(headers, http if refers_to is not None else http + payload)


def write_warc(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Writes files of records, each file a warcinfo record first, to the new folder ``path``.

    The text writer ends every row with one byte of zero.  A gzip member of under 16 MB ends
    with such a byte (the highest of its length), which is left to the writer; behind a longer
    one it is padding, which readers of gzip skip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in runs_of_rows(batches, "payload", 8_000_000):
            members = [] if begun else [_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:warcinfo>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
            begun = True
            members += [_page_member(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] if m[-1] == 0 else m for m in members], pa.binary())], ["member"])

    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    rows = with_roles(pages, pieces_for(size, FILE_BYTES, 4)).mapInArrow(run, "member binary")
    rows.select(F.col("member").cast("string")).write.option("lineSep", "\x00").text(path)


class Framed:
    """Lines and stated lengths out of pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def line(self) -> bytes:
        while (at := self.held.find(b"\r\n")) < 0:
            self.held += self._next()
        out, self.held = self.held[:at], self.held[at + 2 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            piece = self.held or self._next()
            self.held = piece[n:]
            piece = piece[:n]
            n -= len(piece)
            yield piece

    def _next(self) -> bytes:
        piece = next(self.pieces, None)
        if piece is None:
            raise ValueError("a record ends before its stated length")
        return piece

    def at_end(self) -> bool:
        return not self.held and not any(self.pieces)


def members(data: bytes) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Offset and inflated pieces of each gzip member; a caller need not use up the pieces."""
    at, view = 0, memoryview(data)

    def pieces() -> Iterator[bytes]:
        nonlocal at
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof:
            rest = inflate.unconsumed_tail
            if not rest:
                rest = view[at : at + STEP]
                at += len(rest)
                if not rest:
                    raise ValueError("a gzip member is cut off")
            if out := inflate.decompress(rest, STEP):
                yield out
        at -= len(inflate.unused_data)

    while True:
        while at < len(data) and data[at] == 0:
            at += 1
        if at >= len(data):
            return
        body = pieces()
        yield at, body
        for _ in body:
            pass


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _bare(uri: str | None) -> str | None:
    return uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri


def read_record(body: Iterator[bytes], payload: bool) -> dict:
    """One record of a member: the fields of ``FIELDS`` and, where asked for, the payload."""
    framed = Framed(body)
    if not framed.line().startswith(b"WARC/"):
        raise ValueError("a member does not begin with a WARC version")
    headers = _fields(iter(framed.line, b""))
    http = headers.get("content-type", "").startswith("application/http")
    whole, inner, size, parts, head = hashlib.sha256(), hashlib.sha256(), 0, [], b"" if http else None
    for piece in framed.take(int(headers["content-length"])):
        whole.update(piece)
        if head is not None:  # until the blank line behind the HTTP headers
            head += piece
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            answer, piece, head = _fields(iter(head[:end].split(b"\r\n")[1:])), head[end + 4 :], None
        inner.update(piece)
        size += len(piece)
        if payload:
            parts.append(piece)
    if list(framed.take(4)) and not framed.at_end():
        raise ValueError("a member holds more than one record")
    kind, stated = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    ok = headers.get("warc-block-digest") in (None, f"sha256:{whole.hexdigest()}")
    digest = inner.hexdigest()
    if kind == "revisit":  # the payload is in the record referred to
        digest, size = stated, int(answer["content-length"]) if http and head is None else None
    else:
        ok = ok and stated in (None, digest)
    return {
        "record_type": kind,
        "record_id": _bare(headers.get("warc-record-id")),
        "refers_to": _bare(headers.get("warc-refers-to")),
        "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "payload_bytes": size,
        "payload_digest": digest,
        "digest_ok": ok,
        "payload": b"".join(parts) if payload and kind != "revisit" else None,
    }


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all files of a folder: file, offset, the fields of ``FIELDS``, and payload (null for revisits).

    A file goes to one task; it may have 2 GB at most, which is what Spark's reader of whole files takes.
    """
    schema = f"file string, offset long, {FIELDS}" + (", payload binary" if payload else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column("path")[i].as_py(), [], 0
                for offset, body in members(batch.column("content")[i].as_buffer()):
                    record = read_record(body, payload)
                    rows.append(record | {"file": name, "offset": offset})
                    held += len(record["payload"] or b"") + 500
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema).select(*names)


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per page of the archives in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    verified: block and payload digests hold, and a revisit's response is there with the same payload.
    """
    records = read_warc(spark, path, payload=False).where("record_type IN ('response', 'revisit')")
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(RECORD) + 1}) AS long)")
    records = records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "digest_ok")
    sound = records.where("record_type = 'response' AND digest_ok AND page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", F.lit(True).alias("_there")).distinct()
    joined = records.join(sound, ["refers_to", "payload_bytes", "payload_digest"], "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("digest_ok") & (F.col("refers_to").isNull() | F.coalesce("_there", F.lit(False)))).alias("verified"))
