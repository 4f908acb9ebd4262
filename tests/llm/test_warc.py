import gzip
import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest

from oracle import SMALL
from textloom.llm import queries, warc

BIG = "é" * 60
ROWS = [
    (1, "http://a/1", None),
    (2, "http://a/2", ""),
    (7, "http://a/7", BIG),
    (3, "http://a/3 b\r\nX: y", BIG),
    (3, "http://a/3", BIG),
    (9, None, BIG),
    (9, None, BIG),
    (None, "http://a/null", BIG),
    (4, "http://a/4", "x" * 99),
    (5, "http://a/5", "x" * 99),
    (6, "http://a/6", "y" * 100),
    (8, "http://a/8", "y" * 100),
    (10, "http://a/10", "".join(f"{i * 7919 % 104729:x} " for i in range(400000))),
    (11, "http://a/11", "z" * 17_000_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'d' AS digest", "1 AS payload", "2 AS refers_to", "3 AS member").repartition(3)


def brute(rows):
    least = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= 100:
            least[data] = min(page, least.get(data, page))
    out = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = least.get(data)
        again = page is not None and first is not None and page > first
        out[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    return out


def found(df):
    assert all(r["verified"] for r in df.collect())
    return Counter(tuple(r[:5]) for r in df.collect())


def test_round_trip(spark, pages, tmp_path):
    warc.write_warc(pages, f"{tmp_path}/w")
    assert found(warc.page_digests(spark, f"{tmp_path}/w")) == brute(ROWS)
    rows = warc.read_warc(spark, f"{tmp_path}/w").where("record_type = 'response'").collect()
    assert {r["payload"] for r in rows} == {(h or "").encode() for _, _, h in ROWS}
    assert any(r["target_uri"] == "http://a/3%20b%0D%0AX:%20y" for r in rows)
    files = [f for f in Path(tmp_path, "w").iterdir() if f.name.startswith("part")]
    plain = [gzip.decompress(f.read_bytes()) for f in files]  # the standard library reads the same records
    assert sum(len(re.findall(rb"(?m)^WARC-Type: re", p)) for p in plain) == len(ROWS)
    assert all(p.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for p in plain if p)
    for r in rows[:3]:  # a record can be read from its offset alone
        _, body = next(warc.members(Path(r["file"].removeprefix("file:")).read_bytes()[r["offset"] :]))
        assert warc.read_record(body, True)["payload"] == r["payload"]


def test_pages_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(queries.op11_warc(spark, SMALL)) == brute(rows)


def test_empty_table(spark, pages, tmp_path):
    warc.write_warc(pages.where("false"), f"{tmp_path}/none")
    assert warc.page_digests(spark, f"{tmp_path}/none").count() == 0


def test_damaged_records(spark, tmp_path):
    good = warc._page_member(1, "u", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), None, warc.DATE)
    wrong = warc._page_member(2, "u", b"p" * 200, hashlib.sha256(b"q").hexdigest(), None, warc.DATE)
    lost = warc._page_member(3, "u", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), 99, warc.DATE)
    Path(tmp_path, "a").mkdir()
    Path(tmp_path, "a", "x.warc.gz").write_bytes(good + wrong + b"\0\0" + lost)
    rows = {r["page_id"]: r["verified"] for r in warc.page_digests(spark, f"{tmp_path}/a").collect()}
    assert rows == {1: True, 2: False, 3: False}
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(good[:-9]))
    block = gzip.decompress(good)
    with pytest.raises(ValueError, match="stated length"):
        warc.read_record(iter([block[:-60]]), True)
    with pytest.raises(ValueError, match="more than one"):
        warc.read_record(iter([block + block]), True)
