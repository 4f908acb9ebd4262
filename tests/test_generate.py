import numpy as np
from pyspark.sql import functions as F

from textloom.functions import words
from textloom.operators import factor, generate, reports
from textloom.sources import files


def matrix(cells, shape):
    x = np.zeros(shape)
    for r in cells.collect():
        x[tuple(r[m] for m in generate.MODES[: len(shape)])] = r["v"]
    return x


def test_planted_cells_have_their_rank(spark):
    x = matrix(generate.planted(generate.grid(spark, (12, 9)), 3), (12, 9))
    assert np.linalg.matrix_rank(x) == 3 and (x >= 0).all()
    y = matrix(generate.planted(generate.grid(spark, (6, 5, 4)).repartition(7), 2), (6, 5, 4))
    assert np.linalg.matrix_rank(y.reshape(6, 20)) == 2 and np.linalg.matrix_rank(y.transpose(2, 0, 1).reshape(4, 30)) == 2
    z = matrix(generate.planted_relations(generate.grid(spark, (8, 8, 3)), 2), (8, 8, 3))
    assert np.linalg.matrix_rank(z.reshape(8, 24)) == 2 and np.linalg.matrix_rank(z.transpose(1, 0, 2).reshape(8, 24)) == 2
    assert not np.allclose(x, matrix(generate.planted(generate.grid(spark, (12, 9)), 3, seed=8), (12, 9)))


def test_planted_boolean_is_the_boolean_product(spark):
    cells = generate.grid(spark, (20, 15))
    got = matrix(generate.planted_boolean(cells, 3), (20, 15))
    side = lambda m, n: np.array([[r[0] for r in cells.select(F.col(generate.MODES[m]), generate.entry(m, k, 7).alias("u")).distinct().orderBy(generate.MODES[m]).select("u").collect()] for k in range(3)]).T < 0.3
    w, h = side(0, 20), side(1, 15)
    assert (got == (w.astype(int) @ h.T.astype(int) > 0)).all() and 0 < got.mean() < 1


def test_sparse_grids_are_thinned_evenly(spark):
    cells = generate.grid(spark, (200, 100), 0.1)
    assert 1700 < cells.count() < 2300 and cells.select("i").distinct().count() > 190
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, generate.grid(spark, (200, 100), 0.1).repartition(5).collect()))


def test_element_orders(spark):
    rows = spark.createDataFrame([("NaCl",), ("H2O",), ("OO",), ("none",), ("",), (None,), ("MgSO4",)], "m string")
    got = {r["m"]: r["f"] for r in rows.select("m", words.element_orders(F.col("m")).alias("f")).collect()}
    assert got["NaCl"] == ["ClNa", "NaCl", "clna", "nacl"] and got["H2O"] == ["H2O", "OH2", "h2o", "oh2"] and got["OO"] == ["OO", "oo"]
    assert got["none"] == got[""] == [""] and got[None] is None and len(got["MgSO4"]) == 12


def test_objectives_of_the_kernels():
    draw = np.random.default_rng(5)
    a, b = draw.random((12, 2)) + 0.1, draw.random((2, 10)) + 0.1
    x, mask = a @ b, draw.random((12, 10)) > 0.15
    near = lambda m: m * draw.uniform(0.7, 1.3, m.shape)
    holes = np.where(mask, x, 50.0)
    w, h = factor.nmf_kullback(holes, near(a), near(b), 5000, mask)
    assert factor.relative_error(x, w, h) < 1e-2
    assert factor.relative_error(x, *factor.weighted_nmf(holes, mask.astype(float), near(a), near(b), 500)) < 1e-2
    s = draw.random((12, 3))
    start = near(s)
    errors = [np.linalg.norm(s @ s.T - (w := factor.symmetric_nmf(s @ s.T, start, n)) @ w.T) for n in (1, 10, 100, 1000)]
    assert all(p > q for p, q in zip(errors, errors[1:], strict=False))
    y = a @ draw.random((2, 3)) @ draw.random((3, 10))
    parts = near(a), draw.random((2, 3)), draw.random((3, 10))
    errors = [np.linalg.norm(y - w @ c @ h) for w, c, h in (factor.tri_nmf(y, *parts, n) for n in (1, 10, 100, 1000))]
    assert all(p > q for p, q in zip(errors, errors[1:], strict=False)) and errors[-1] < 0.02 * np.linalg.norm(y)


def test_chained_steps_and_saved_factors(spark, tmp_path):
    rows = spark.range(20)
    steps = {"even": lambda df: df.where("id % 2 = 0"), "large": lambda df: df.where("id > 9"), "none": lambda df: df.limit(0)}
    assert [r[0] for r in reports.chained(rows, steps, ["even", "large"]).orderBy("id").collect()] == [10, 12, 14, 16, 18]
    assert reports.chained(rows, steps).count() == 0 and reports.chained(rows, {}).count() == 20
    files.save_factors({k: spark.createDataFrame([(i, [float(i)] * k) for i in range(3)], "i long, w array<double>") for k in (2, 3)}, f"{tmp_path}/factors")
    back = spark.read.parquet(f"{tmp_path}/factors")
    assert {(r["k"], r["i"], tuple(r["w"])) for r in back.collect()} == {(k, i, (float(i),) * k) for k in (2, 3) for i in range(3)}
