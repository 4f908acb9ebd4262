import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators.evidence import importances, rank_by_test, signed_ranks


def by_hand(pairs):
    """n, sums of ranks and the exact p-value over all signs (without ties and zeros)."""
    d = sorted((x - y for x, y in pairs if x != y), key=abs)
    ranks = {}
    for v, own in itertools.groupby(enumerate(d, 1), key=lambda t: abs(t[1])):
        own = [k for k, _ in own]
        ranks[v] = sum(own) / len(own)
    plus, minus = (sum(ranks[abs(v)] for v in d if (v > 0) == up) for up in (True, False))
    low, sums = min(plus, minus), [sum(k + 1 for k in range(len(d)) if s >> k & 1) for s in range(2 ** len(d))]
    return len(d), plus, minus, min(1.0, 2 * sum(x <= low for x in sums) / len(sums))


def test_exact_tails_by_key(spark):
    rng = random.Random(5)
    groups = {k: [(rng.uniform(0, 9), rng.uniform(0, 9) + k) for _ in range(6 + k)] for k in range(4)}
    rows = spark.createDataFrame([(k, x, y) for k, own in groups.items() for x, y in own] + [(0, None, 1.0), (0, float("nan"), 1.0)], "k int, x double, y double")
    got = {r["k"]: r for r in signed_ranks(rows, ["k"]).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for k, own in groups.items():
        n, plus, minus, p = by_hand(own)
        assert (got[k]["n"], got[k]["n_zero"]) == (n, 0)
        assert (got[k]["w_plus"], got[k]["w_minus"], got[k]["p_value"]) == pytest.approx((plus, minus, p))


def test_a_table_worked_by_hand(spark):
    # differences 1 -1 2 2 -3 and a zero: ranks 1.5 1.5 3.5 3.5 5, so 8.5 against 6.5
    pairs = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (5.0, 3.0), (6.0, 4.0), (0.0, 3.0), (7.0, 7.0)], "x double, y double")
    got = signed_ranks(pairs).collect()
    assert len(got) == 1 and (got[0]["n"], got[0]["n_zero"], got[0]["w_plus"], got[0]["w_minus"]) == (5, 1, 8.5, 6.5)
    # mean 7.5, variance 5 * 6 * 11 / 24 - (6 + 6) / 48 = 13.5
    assert got[0]["z"] == pytest.approx(-1 / 13.5**0.5)
    assert got[0]["p_value"] == pytest.approx(0.785494, abs=1e-6)


def test_zeros_only_null_keys_and_none(spark):
    rows = spark.createDataFrame([(None, 1.0, 1.0), (1, 2.0, 1.0)], "k int, x double, y double")
    got = {r["k"]: r for r in signed_ranks(rows, ["k"]).collect()}
    assert (got[None]["n"], got[None]["n_zero"], got[None]["p_value"]) == (0, 1, 1.0) and got[1]["p_value"] == 1.0
    assert signed_ranks(rows.where("false"), ["k"]).count() == 0


def test_choice_of_rank(spark):
    rng = random.Random(1)
    level = {2: 5.0, 3: 1.0, 4: 1.0, 5: 0.2}
    errors = spark.createDataFrame([(r, i, e + rng.gauss(0, 0.05)) for r, e in level.items() for i in range(20)], "rank int, i int, error double")
    rank, told = rank_by_test(errors, {2: 0.99, 3: 0.95, 4: 0.93, 5: 0.3})
    assert rank == 3 and told[3] < 0.001 and sorted(told) == [3, 4] and told[4] > 0.05  # 5 is not stable
    assert rank_by_test(errors, {2: 0.99, 3: 0.95, 4: 0.93, 5: 0.95}) == (5, {})
    assert rank_by_test(errors, {4: 0.1}) == (4, {})


def test_planted_feature_ranks_first(spark):
    rng = random.Random(3)
    rows = [(j, [rng.random() for _ in range(4)]) for j in range(300)]
    features = spark.createDataFrame(rows, "j int, h array<double>")
    known = spark.createDataFrame([(j, 3 * h[2] - h[0]) for j, h in rows if j % 3], "j int, y double").withColumn("extra", F.lit(1))
    got = {r["feature"]: r["importance"] for r in importances(features, known).collect()}
    assert sorted(got) == [0, 1, 2, 3] and sorted(got, key=got.get)[-2:] == [0, 2]
    assert got[2] == pytest.approx(2 * 9 / 12, rel=0.3) and abs(got[1]) < 1e-3 and abs(got[3]) < 1e-3
    assert importances(features, known.where("false")).count() == 0
