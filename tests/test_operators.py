from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.graph.components import connected_components
from textloom.graph.ranks import hits, pagerank
from textloom.operators import factor, stats, tensor, text


def test_components_of_chains_stars_and_loops(spark):
    rows = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (500, 499)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert {found[k] for k in range(1, 41)} == {1} and {found[k] for k in range(100, 160)} == {100} and found[500] == 499


def test_stars_need_no_round_and_leave_one_table(spark):
    from textloom.graph import components as module

    tables = []

    def cut(df):
        tables.append(module.written(df))
        return tables[-1]

    star = spark.createDataFrame([(1, n) for n in range(2, 30)] + [(40, 41)], "src long, dst long")
    found = {r["node"]: r["component"] for r in connected_components(star, cut=cut).collect()}
    assert found == {n: 1 for n in range(1, 30)} | {40: 40, 41: 40} and len(tables) == 1
    tables.clear()
    chain = spark.createDataFrame([(n, n + 1) for n in range(60)], "src long, dst long")
    was, module.written = module.written, lambda df: tables.append(was(df)) or tables[-1]
    try:
        out = connected_components(chain, cut=module.written)
    finally:
        module.written = was
    there = [Path(t.inputFiles()[0].removeprefix("file:")).exists() for t in tables]
    assert len(tables) > 2 and there == [False] * (len(tables) - 1) + [True]
    assert {r["component"] for r in out.collect()} == {0} and out.count() == 61


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pagerank_sums_to_one_with_dangling_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 1.0), (4, 1, 1.0)], "src long, dst long, weight double")
    assert abs(pagerank(edges).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert abs(hits(edges, 10).agg(F.sum("hub")).first()[0] - 1) < 1e-9


def test_copyright_and_empty_text(spark):
    cases = {"© 2020 X. Body text.": "Body text.", "Body text long enough © 2020": "Body text long enough ", "plain": "plain", "a © longer tail": "a © longer tail"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.remove_copyright(F.col("t")).alias("o")).collect()
    assert {r["t"]: r["o"] for r in rows} == cases
    empty = spark.createDataFrame([("",), (None,), ("  ",)], "t string")
    assert [r[0] for r in empty.select(T.clean(F.col("t"), [F.lower])).collect()] == [None] * 3
    assert [r[0] for r in empty.select(F.size(T.tokens(F.col("t")))).collect()] == [0] * 3


def test_fold_undoes_unfold(spark):
    cells = spark.createDataFrame([(0, 1, 2, 5.0), (3, 2, 0, 1.0)], "i long, j long, t long, v double")
    there = tensor.unfold(cells, "i", ("j", "t"), 4)
    assert sorted(map(tuple, tensor.fold(there, "i", ("j", "t"), 4).select("i", "j", "t", "v").collect())) == sorted(map(tuple, cells.collect()))


def test_window_search_and_rules(spark):
    docs = spark.createDataFrame([(1, "a b x x c"), (2, "c b a"), (3, None), (4, "A x C")], "doc_id long, text string")
    assert {r[0] for r in text.ordered_window(docs, ["a", "c"], 4).collect()} == {4}
    assert {r[0] for r in text.ordered_window(docs, ["a", "c"], 5).collect()} == {1, 4}


def test_null_keys_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")], "k long, v string")
    assert stats.drop_by_fewest_nulls(rows, "k", ["v"]).count() == 4
    assert stats.merge_prefer_left(rows, rows, "k").where("k IS NULL").count() == 4


def test_kernels_recover_exact_products():
    draw = np.random.default_rng(0)
    w, h = draw.random((30, 3)), draw.random((3, 40))
    x = w @ h
    near = lambda a: a * draw.uniform(0.9, 1.1, a.shape)
    for kernel in (factor.nmf_frobenius, factor.nmf_kullback):
        assert factor.relative_error(x, *kernel(x, near(w), near(h), 2000)) < 1e-3
    a, r = draw.random((6, 2)), draw.random((3, 2, 2))
    xs = np.stack([a @ rt @ a.T for rt in r])
    a2, r2 = factor.rescal(xs, near(a), near(r), 2000)
    assert np.linalg.norm(xs - np.stack([a2 @ rt @ a2.T for rt in r2])) / np.linalg.norm(xs) < 1e-2
    s = draw.random((3, 2))
    y = w @ s @ draw.random((2, 20))
    assert np.isfinite(factor.tri_nmf(y, near(w), near(s), draw.random((2, 20)), 200)[1]).all()


def test_clusters_of_permuted_solutions():
    draw = np.random.default_rng(1)
    w = draw.random((5, 3))
    w_all = np.stack([w[:, draw.permutation(3)] for _ in range(6)], 2)
    centre, placed = factor.cluster_solutions(w_all)
    assert np.allclose(centre, w_all[:, :, 0]) and np.allclose(placed, centre[:, :, None])
    assert (factor.silhouettes(placed) > 0.99).all()


def test_distributed_form_reaches_a_small_error(spark):
    draw = np.random.default_rng(2)
    x = draw.random((12, 2)) @ draw.random((2, 9))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(9)], "i int, j int, v double")
    assert factor.distributed_nmf(cells, 2, 12)[2] < 0.15
