import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators.consensus import ambiguous_share, average_linkage, cophenetic

RUNS = 8


def labelled(spark, table):
    return spark.createDataFrame([(r, i, int(x)) for i, own in table.items() for r, x in enumerate(own)], "run int, i long, label int")


def agreement(table):
    return {(i, j): sum(x == y for x, y in zip(table[i], table[j])) / RUNS for i in table for j in table if i < j}


def by_hand(table):
    """Merge heights, cophenetic similarities of all pairs and leaf order, with the nearest pair of clusters (smallest names on a tie) merged one by one."""
    sim, clusters = agreement(table), {i: [i] for i in table}
    coph, heights = {}, []
    near = lambda a, b: np.mean([sim[min(x, y), max(x, y)] for x in clusters[a] for y in clusters[b]])
    while True:
        best = max(((round(near(a, b), 12), -a, -b) for a in clusters for b in clusters if a < b), default=(0, 0, 0))
        if best[0] <= 0:
            break
        s, a, b = best[0], -best[1], -best[2]
        for x in clusters[a]:
            for y in clusters[b]:
                coph[min(x, y), max(x, y)] = s
        heights.append(round(1 - s, 9))
        clusters[a] = clusters[a] + clusters.pop(b)
    return heights, {p: coph.get(p, 0.0) for p in sim}, [i for a in sorted(clusters) for i in clusters[a]]


def noisy(seed, rows, groups=3, flips=0.2):
    rng = random.Random(seed)
    return {i: [(i % groups) if rng.random() > flips else rng.randrange(groups + 2) for _ in range(RUNS)] for i in range(1, rows + 1)}


@pytest.mark.parametrize("table", [noisy(1, 14), noisy(2, 11, 2, 0.35), {i: [i % 3] * RUNS for i in range(1, 10)} | {20: list(range(10, 10 + RUNS))}], ids=["three", "two", "planted"])
def test_linkage_against_all_pairs(spark, table):
    labels = labelled(spark, table)
    merges, order = average_linkage(labels)
    heights, coph, _ = by_hand(table)
    inside = {tuple(v) for v in table.values()}
    own = sorted(round(r["height"], 9) for r in merges.collect())
    # rows of one profile are never merged by the operator: their heights are 0
    assert own == pytest.approx(sorted(heights)[len(table) - len(inside):])
    places = {r["i"]: r["place"] for r in order.collect()}
    assert sorted(places) == sorted(table) and sorted(places.values()) == list(range(len(table)))
    sim = agreement(table)
    want = np.corrcoef([sim[p] for p in sim], [coph[p] for p in sim])[0, 1]
    assert cophenetic(labels, merges).first()[0] == pytest.approx(want)
    pac = np.mean([0.1 < s < 0.9 for s in sim.values()])
    assert ambiguous_share(labels).first()["pac"] == pytest.approx(pac)


def test_clusters_stand_together_in_the_order(spark):
    table = {i: [i % 3] * RUNS for i in range(1, 31)}
    table[7] = [1] * (RUNS - 2) + [0] * 2  # mostly of cluster 1
    _, order = average_linkage(labelled(spark, table))
    seen = [table[r["i"]][0] for r in order.orderBy("place").collect()]
    assert sum(x != y for x, y in zip(seen, seen[1:])) == 2


def test_none_and_one(spark):
    for table in ({}, {1: [0] * RUNS}):
        labels = labelled(spark, table) if table else spark.createDataFrame([], "run int, i long, label int")
        merges, order = average_linkage(labels)
        assert merges.count() == 0 and order.count() == len(table)
        assert cophenetic(labels, merges).first()[0] is None and ambiguous_share(labels).first()["pac"] is None


def test_extra_columns_do_not_clash(spark):
    labels = labelled(spark, noisy(3, 6)).withColumn("n", F.lit(1)).withColumn("a", F.lit("x"))
    assert average_linkage(labels)[1].count() == 6
