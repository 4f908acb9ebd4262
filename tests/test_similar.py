import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.graph import paths
from textloom.operators import similar


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def strings():
    rng = random.Random(5)
    out = ["", "a", "ab", "ba", "naïve Übung", "東京 🙂 tower", "aaaaaaaaaa", "aaaaaaaaab"]
    for _ in range(25):
        base = "".join(rng.choice("abcdefg ") for _ in range(rng.randint(2, 45)))
        out.append(base)
        for _ in range(3):
            edited = list(base)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(edited) + 1)
                edited[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "b"])
            out.append("".join(edited))
    return out


def test_bit_rows_equal_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert similar.common_length(a, b) == slow_common(a, b)


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.12, 0.3])
def test_no_pair_is_lost(spark, threshold):
    given = strings()
    frame = spark.createDataFrame([(s,) for s in given] + [(None,), ("ab",)], "value string")
    want = {}
    for a in set(given):
        for b in set(given):
            d = 1 - 2 * slow_common(a, b) / (len(a) + len(b)) if a and b else 1
            if d <= threshold + 1e-12:
                want[a, b] = d
    found = {(r["a"], r["b"]): r["distance"] for r in similar.ratio_pairs(frame, frame, threshold).collect()}
    assert found == pytest.approx(want)
    assert similar.ratio_pairs(frame, frame.where("false"), threshold).count() == 0


def test_join_and_groups(spark):
    left = spark.createDataFrame([(1, "a long title about graphs"), (2, "short"), (3, None), (4, "nothing like the others")], "id int, t string")
    right = spark.createDataFrame([("a long title about graph",), ("a long title about grapes",), ("short",)], "u string")
    rows = {r["id"]: (r["match"], r["distance"]) for r in similar.ratio_join(left, right, ("t", "u"), 0.1).collect()}
    assert rows[1] == ("a long title about graph", pytest.approx(1 / 49)) and rows[2] == rows[3] == rows[4] == (None, None)
    titles = spark.createDataFrame([("abcdefghij",), ("abcdefghijk",), ("abcdefghijkl",), ("other words",)], "t string")
    assert {(r["value"], r["group"]) for r in similar.ratio_groups(titles, "t", 0.06).collect()} == {("abcdefghij", "abcdefghij"), ("abcdefghijk", "abcdefghij"), ("abcdefghijkl", "abcdefghij"), ("other words", "other words")}


def test_words_and_topics(spark):
    frame = spark.createDataFrame([("cats", "cat"), ("dog", "cat"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in frame.select(similar.word_similarity(F.col("a"), F.col("b"))).collect()] == [0.75, 0.0, 0.0, 0.0]
    assert [r[0] for r in frame.select(similar.longest_common(F.col("a"), F.col("b"))).collect()] == [3, 0, 0, None]
    one = spark.createDataFrame([(0, "graph"), (0, "graphs"), (1, "tensor")], "topic int, word string")
    two = spark.createDataFrame([(0, "tensors"), (1, "graph"), (2, "music")], "topic int, word string")
    assert [(i, j) for i, j, _ in similar.matched_topics(one, two)] == [(0, 1), (1, 0)]
    assert [(i, j) for i, j, _ in similar.matched_topics(two, one)] == [(0, 1), (1, 0)]


def strong(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_strong_components_of_runs_rings_and_cores(spark):
    rng = random.Random(2)
    ring = [(k, k + 1) for k in range(20, 27)] + [(27, 20)]
    looped = [(30, 31), (31, 30), (30, 32), (32, 33), (33, 34), (34, 31), (34, 40), (40, 41), (41, 42), (42, 43)]
    core = [(rng.randrange(100, 120), rng.randrange(100, 120)) for _ in range(34)]
    edges = [e for e in ring + looped + core + [(43, 100), (27, 200), (200, 201), (201, 202)] if e[0] != e[1]]
    found = {r["node"]: r["component"] for r in paths.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == strong(edges)


def test_long_chain(spark):
    begun = time.time()
    edges = spark.range(1000).selectExpr("id AS src", "id + 1 AS dst")
    assert paths.strong_components(edges).where("node = component").count() == 1001
    assert time.time() - begun < 90
