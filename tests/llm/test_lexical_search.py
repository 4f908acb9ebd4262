import math
import re
from collections import Counter

import numpy as np
import pytest
from test_llm import PASSAGE, ROWS

from textloom.llm import lexical_search

ITEMS = [(1, PASSAGE), (2, "The w12 w13 apache LICENSE"), (3, None), (4, "..."), (5, "nothing-of-this qqq"), (6, "one"), (6, "one One"), (None, "naïve 東京 🙂 w1 w2 the")]


def tokens(text):
    return [m.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for m in re.findall(lexical_search.TERM, text or "")]


def brute(docs, items, k):
    docs = [(i, Counter(w), len(w)) for i, t in docs if (w := tokens(t))]
    n, total, out = len(docs), sum(d[2] for d in docs), Counter()
    df = Counter(t for _, c, _ in docs for t in c)
    for item, text in items:
        rows = []
        for i, c, size in docs:
            m = 100 - 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(tokens(text)) if c[t])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(rows)[:k], 1):
            out[(item, rank, None if null else i, -score)] += 1
    return out


def found(rows):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect())


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score", "3 AS rank")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "'x' AS terms", "1 AS item_id", "2 AS score").repartition(3)


@pytest.mark.parametrize("k", [2, 50])
def test_small_texts(docs, items, k):
    assert found(lexical_search.ranked_documents(docs, items, k)) == brute([(r[0], r[1]) for r in ROWS], ITEMS, k)


def test_empty_tables(docs, items):
    assert lexical_search.ranked_documents(docs.where("false"), items).count() == 0
    assert lexical_search.ranked_documents(docs, items.where("false")).count() == 0


def test_segments_blocks_and_skips(spark, monkeypatch):
    """Many documents with common and rare terms, ties among them: many segments, several blocks, small steps."""
    rng = np.random.default_rng(5)
    words = [f"t{int(w)}" for w in rng.zipf(1.3, 60000) % 3000]
    cuts = np.sort(rng.integers(0, len(words), 1500))
    rows = [(int(i) * 7 % 2003, " ".join(words[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [(5000 + i, "t1 t2 t900") for i in range(120)]
    asked = [(i, " ".join(words[i * 31 : i * 31 + 3 + i % 30])) for i in range(60)] + [(99, "t1 t2 t900")]
    want = brute(rows, asked, 10)
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), spark.createDataFrame(asked, "item_id long, text string")
    for name, value in (("STEP", 16), ("SEGMENT", 20000), ("QUERY_BYTES", 2000)):
        monkeypatch.setattr(lexical_search, name, value)
    assert found(lexical_search.ranked_documents(docs, items, 10)) == want
    segment = lexical_search.Building()
    for i, t in rows:
        segment.add(i, t.encode())
    n, total = segment.row()["n_docs"], segment.row()["n_terms"]
    built = lexical_search.Segment(segment.row(), {b"t1": 5, b"t2": 7, b"t900": 6000}, n, total)
    best = lexical_search.Best(10)
    assert lexical_search.rank_segment(built, [b"t1", b"t2", b"t900"], best) < n / 3  # long lists alone propose nothing
    assert len(best.ids) == 10


def test_long_text_in_parts():
    text = ("Äb c1-D " * 5000).encode()
    assert lexical_search.term_counts(text, 100) == Counter({"Äb".encode(): 5000, b"c1": 5000, b"d": 5000})
