import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ensemble, factor, hierarchy


def planted(rng, n, k):
    out = np.zeros((n, k))
    out[np.arange(n), np.arange(n) % k] = 1 + rng.random(n)
    return out


def cells_of(spark, matrices):
    rows = [(name, i, j, float(x[i, j])) for name, x in matrices.items() for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] > 0]
    return spark.createDataFrame(rows, "node string, i long, j long, v double")


def chosen(table):
    return {r["node"]: r["rank"] for r in table.where("selected").collect()}


def test_rank_of_every_node_in_one_ensemble(spark):
    rng, times = np.random.default_rng(1), 20
    given = {"a": planted(rng, 24, 2) @ planted(rng, 18, 2).T * times, "b": planted(rng, 24, 3) @ planted(rng, 20, 3).T * times}
    table, w, h = ensemble.select_ranks(cells_of(spark, given), [2, 3, 4], runs=3, noise="poisson", rounds=5)
    assert chosen(table) == {"a": 2, "b": 3}
    assert table.count() == 6
    found = {(r["node"], r["i"]): r["f"][2:5] for r in w.collect()}  # the block of rank 3
    across = {(r["node"], r["j"]): r["f"][2:5] for r in h.collect()}
    model = np.array([found["b", i] for i in range(24)]) @ np.array([across["b", j] for j in range(20)]).T
    error = np.linalg.norm(given["b"] - model) / np.linalg.norm(given["b"])
    told = table.where("node = 'b' AND rank = 3").first()["error"]
    assert error == pytest.approx(told, abs=1e-4) and told < 0.01


def test_boolean_product_from_flipped_cells(spark):
    rng = np.random.default_rng(3)
    x = (planted(rng, 30, 3) @ planted(rng, 24, 3).T > 0).astype(float)
    cells = cells_of(spark, {"a": x})
    copies = ensemble.perturbed(cells, 3, "boolean", (0.04, 0.05))
    held = {r["run"]: r["n"] for r in copies.groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert held[0] == x.sum() and len(set(held.values())) > 1
    added = copies.where("run > 0").join(cells.select("i", "j"), ["i", "j"], "left_anti").count()
    assert 20 < added < 150  # of 3 x 480 zeros
    table, w, _ = ensemble.select_ranks(cells, [2, 3, 4], runs=3, noise="boolean", epsilon=(0.02, 0.02), rounds=5)
    assert chosen(table) == {"a": 3}
    bits = ensemble.as_bits(w.withColumn("run", F.lit(0)), "i", [2, 3, 4])
    groups = {tuple(sorted(r["i"] for r in g)) for g in _grouped(bits)}
    assert groups == {tuple(range(k, 30, 3)) for k in range(3)}


def _grouped(bits):
    out = {}
    for r in bits.collect():
        out.setdefault(tuple(r["f"][2:5]), []).append(r)
    return out.values()


def test_poisson_numbers():
    seeds = np.random.default_rng(0).integers(-(2**62), 2**62, 40000)
    for mean in (0.3, 7.0, 180.0, 20000.0):
        drawn = ensemble.poisson(np.full(40000, mean), seeds)
        assert drawn.mean() == pytest.approx(mean, rel=0.03) and drawn.var() == pytest.approx(mean, rel=0.05)
    assert (ensemble.poisson(np.zeros(5), seeds[:5]) == 0).all()


def test_symmetric_newton_steps(spark):
    rng = np.random.default_rng(2)
    given = {name: planted(rng, 24, k) for name, k in (("a", 3), ("b", 2))}
    cells = cells_of(spark, {n: q @ q.T + 0.01 for n, q in given.items()})
    table, _ = ensemble.select_ranks_symmetric(cells, [2, 3, 4], runs=3, rounds=8)
    assert chosen(table) == {"a": 3, "b": 2}
    w, told = ensemble.symmetric_fit(ensemble.perturbed(cells, 0), [3], rounds=6)
    for key in told[0]:
        seen = [t[key][0] for t in told]
        assert all(b <= a for a, b in itertools.pairwise(seen)) and seen[-1] < 0.2 * seen[0]
    rows = {(r["node"], r["i"]): r["f"] for r in w.collect()}
    model = np.array([rows["a", i] for i in range(24)])
    assert np.linalg.norm(model @ model.T - given["a"] @ given["a"].T - 0.01) ** 2 == pytest.approx(told[-1]["a", 0][0], rel=1e-6)


def test_three_factors(spark):
    rng = np.random.default_rng(1)
    middle = np.array([[5, 0.5, 0.2], [0.3, 4, 1], [1, 0.1, 3.0]])
    x = planted(rng, 24, 3) @ middle @ planted(rng, 20, 3).T
    table = ensemble.select_ranks_three(cells_of(spark, {"a": x}), [2, 3], [2, 3], runs=3, rounds=5)
    best = table.where("selected").first()
    assert (best["k1"], best["k2"]) == (3, 3) and best["error"] < 0.01


def test_assignment_where_greed_fails():
    cost = np.array([[1.0, 2.0, 9.0], [1.1, 9.0, 9.0], [9.0, 3.0, 4.0]])
    assert ensemble.assign(cost).tolist() == [1, 0, 2]
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 5), (5, 5), (6, 7)):
        for _ in range(20):
            cost = rng.normal(size=(n, m))
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            found = ensemble.assign(cost)
            assert len(set(found)) == n and cost[np.arange(n), found].sum() == pytest.approx(best)
    a = np.array([[1.0, 0.9], [0.0, 0.5]])
    assert factor.matching_error(a, a[:, ::-1] * 3) == pytest.approx(0)


def test_silhouettes_from_products():
    """The fixed case of columns 0..59 as (4, 3, 5), by inner products as by columns."""
    placed = np.arange(60.0).reshape(4, 3, 5)
    flat = placed.transpose(2, 1, 0).reshape(15, 4)  # run by run
    order, s = ensemble.judged(flat @ flat.T, 3, 5)
    kept = np.stack([flat[order[r]].T for r in range(5)], 2)
    assert s == pytest.approx(factor.silhouettes(kept))


def test_tree_with_unequal_ranks(spark):
    rows = []
    for i in range(60):
        top = i % 2
        sub = i // 2 % (3 if top else 2)
        last = i // 12 % 2 if (top, sub) == (0, 1) else 0
        rows += [(i, f"t{top}{k}", 6.0) for k in range(4)] + [(i, f"s{top}{sub}{k}", 3.0) for k in range(3)] + [(i, f"l{top}{sub}{last}{k}", 1.0) for k in range(2)]
    cells = spark.createDataFrame(rows, "i long, j string, v double")
    leaves = hierarchy.ranked_topic_tree(cells, [2, 3], depth=2, least=10, runs=3, rounds=5)
    groups = {tuple(sorted(g)) for g in _by(leaves.collect())}
    want = {tuple(i for i in range(60) if (i % 2, i // 2 % (3 if i % 2 else 2)) == (t, s)) for t in (0, 1) for s in range(3 if t else 2)}
    assert groups == want
    nodes = {r["node"]: r for r in hierarchy.tree_nodes(leaves).collect()}
    assert nodes["0"]["n_rows"] == 60 and nodes["0"]["parent"] is None and sorted(nodes[c]["n_children"] for c in nodes if nodes[c]["depth"] == 1) == [2, 3]
    assert hierarchy.under(leaves, "0.1").count() == nodes["0.1"]["n_rows"] == 30
    # cells made anew for each node: only what tells its rows apart
    fresh = hierarchy.ranked_topic_tree(cells, [2, 3], depth=1, least=10, runs=3, rounds=7, cells_of=lambda active: active.join(cells.where("j LIKE 't%'"), "i").select("node", "i", "j", "v"))
    assert {tuple(sorted(g)) for g in _by(fresh.collect())} == {tuple(range(0, 60, 2)), tuple(range(1, 60, 2))}


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r["node"], []).append(r["i"])
    return out.values()
