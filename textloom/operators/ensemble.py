"""Ensembles of factorizations: every node, perturbed copy and rank in the same Spark jobs.

A factor is a table (node, run, key, f).  ``node`` tells matrices apart, ``run`` their
perturbed copies (run 0 is the matrix as given), and ``f`` holds the rows of all ranks
that are tried, one block behind the other.  A half round is one join of cells with the
other factor, one aggregation by the own key, and a row-wise update in Arrow batches.
Only sums over rows (Gram matrices, inner products) reach the driver: for each node and
run as many numbers as the squares of the ranks add up to.

Random numbers are hashes of the keys, so a lost partition is made again alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

TINY = 1e-12
#: Poisson means up to this are drawn exactly; larger ones are normal, rounded.
EXACT = 10_000
#: Lengths that a Newton step is tried at, in this order.
STEPS = (1.0, 0.5, 0.1, 0.01)
Small = dict[tuple, list[np.ndarray]]


def unit(*parts: Column) -> Column:
    """A number in [0, 1) drawn by hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def poisson(mean: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Poisson numbers of each mean by inversion, in parts of 50 at most (sums of Poisson numbers are Poisson)."""
    mean, out, part = np.maximum(mean, 0.0), np.zeros(len(mean)), 0
    draw = lambda p: (np.random.SeedSequence(p).generate_state(1, np.uint64)[0] ^ seed.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)

    def uniform(p: int) -> np.ndarray:
        x = draw(p)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)

    large = mean > EXACT
    if large.any():
        normal = np.sqrt(-2 * np.log(1 - uniform(1))) * np.cos(2 * np.pi * uniform(2))
        out[large] = np.maximum(np.rint(mean + np.sqrt(mean) * normal), 0)[large]
    left = np.where(large, 0.0, mean)
    while (left > 0).any():
        own, u = np.minimum(left, 50.0), uniform(3 + part)
        chance = np.exp(-own)
        total, k = chance.copy(), 0
        open_ = (u >= total) & (own > 0)
        while open_.any() and k < 400:
            k += 1
            out[open_] += 1
            chance = chance * own / k
            total += chance
            open_ &= u >= total
        left, part = left - own, part + 1
    return out


def perturbed(cells: DataFrame, runs: int, noise: str = "uniform", epsilon: float | tuple[float, float] = 0.03, seed: int = 7) -> DataFrame:
    """node, run, i, j, v: the cells (node, i, j, v) as they are (run 0) and ``runs`` perturbed copies.

    uniform: times a number in (1 - epsilon, 1 + epsilon); poisson: a Poisson number of mean v; boolean:
    ``epsilon`` is (share of zeros that become 1, share of ones that become 0).
    """
    given = cells.groupBy("node", "i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    copies = given.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs))))
    same = F.col("run") == 0
    keys = (F.col("node"), F.col("i"), F.col("j"), F.col("run"), F.lit(seed))
    if noise == "uniform":
        out = copies.withColumn("v", F.when(same, F.col("v")).otherwise(F.col("v") * (1 - epsilon + 2 * epsilon * unit(*keys))))
    elif noise == "poisson":

        def drawn(v: pd.Series, h: pd.Series) -> pd.Series:
            return pd.Series(poisson(v.to_numpy(), h.to_numpy()))

        out = copies.withColumn("v", F.when(same, F.col("v")).otherwise(F.pandas_udf(drawn, "double")("v", F.xxhash64(*keys))))
    elif noise == "boolean":
        ones = copies.where("v > 0").withColumn("v", F.lit(1.0)).where(same | (unit(*keys) >= epsilon[1]))
        out = ones.unionByName(_flips(given.where("v > 0"), runs, epsilon[0], seed))
    else:
        raise ValueError(f"no noise is called {noise}")
    return written(out.where("v > 0").select("node", "run", "i", "j", "v"))


def _flips(ones: DataFrame, runs: int, share: float, seed: int) -> DataFrame:
    """Cells without a value that become 1: rows draw places among the node's numbered columns."""
    columns = ones.select("node", "j").distinct().withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("j")) - 1)
    rows = ones.select("node", "i").distinct().join(columns.groupBy("node").agg(F.count("*").alias("m")), "node")

    def draw(m: pd.Series, h: pd.Series) -> pd.Series:
        def one(size: int, key: int) -> list[int]:
            rng = np.random.default_rng(key & 0xFFFFFFFFFFFFFFFF)
            return rng.choice(size, rng.binomial(size, share), replace=False).tolist()

        return pd.Series([one(int(a), int(b)) for a, b in zip(m, h, strict=True)])

    drawn = rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("at", F.explode(F.pandas_udf(draw, "array<int>")("m", F.xxhash64("node", "i", "run", F.lit(seed)))))
    return drawn.join(columns, ["node", "at"]).join(ones, ["node", "i", "j"], "left_anti").select("node", "i", "j", F.lit(1.0).alias("v"), "run")


def start(cells: DataFrame, key: str, width: int, seed: int) -> DataFrame:
    """node, run, key, f for every key of a node in every run."""
    keys = cells.select("node", key).distinct().join(cells.select("node", "run").distinct(), "node")
    return written(keys.withColumn("f", F.array(*(0.1 + unit(F.col("node"), F.col("run"), F.col(key), F.lit(1000 * seed + a)) for a in range(width)))))


def contracted(cells: DataFrame, key: str, other: DataFrame, other_key: str, width: int) -> DataFrame:
    """node, run, key, up: cells times the other factor."""
    met = cells.join(other.select("node", "run", other_key, "f"), ["node", "run", other_key])
    return met.groupBy("node", "run", key).agg(F.array(*(F.sum(F.col("v") * F.col("f")[a]) for a in range(width))).alias("up"))


def _numbers(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    keys = pd.MultiIndex.from_arrays([batch.column("node").to_pylist(), batch.column("run").to_pylist()])
    codes, names = keys.factorize()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(names)))
    for name, end, begin in zip(names, ends, np.concatenate([[0], ends[:-1]]), strict=True):
        yield name, order[begin:end]


def stepped(own: DataFrame, key: str, up: DataFrame, width: int, small: Small, rule: Callable[..., np.ndarray]) -> DataFrame:
    """node, run, key, f, up: every row of ``own`` by rule(small matrices of its node and run, f, up)."""
    kind, node = own.schema[key].dataType.simpleString(), own.schema["node"].dataType.simpleString()
    shared = own.sparkSession.sparkContext.broadcast(small)
    rows = own.select("node", "run", key, "f").join(up, ["node", "run", key], "left").withColumn("up", F.coalesce("up", F.array_repeat(F.lit(0.0), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                f, up = _numbers(batch.column("f"), n), _numbers(batch.column("up"), n)
                new = None
                for name, at in _groups(batch):
                    made = rule(shared.value[name], f[at], up[at])
                    new = np.empty((n, made.shape[1])) if new is None else new
                    new[at] = made
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, new.shape[1]), pa.int32()), pa.array(new.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("run"), batch.column(key), lists, batch.column("up")], ["node", "run", key, "f", "up"])

    return written(rows.mapInArrow(run, f"node {node}, run int, {key} {kind}, f array<double>, up array<double>"))


def reduced(rows: DataFrame, measure: Callable[..., np.ndarray]) -> dict[tuple, np.ndarray]:
    """For each node and run the sum over rows of measure(f, up), worked out per task and added up by Spark."""
    node = rows.schema["node"].dataType.simpleString()
    with_up = "up" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if n := batch.num_rows:
                f, up = _numbers(batch.column("f"), n), _numbers(batch.column("up"), n) if with_up else None
                for name, at in _groups(batch):
                    own = measure(f[at], up[at] if with_up else None)
                    found[name] = found[name] + own if name in found else own
        for (a, b), values in found.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"node": [a] * len(values), "run": np.int32(b), "at": np.arange(len(values), dtype=np.int32), "value": values}), preserve_index=False)

    parts = rows.select("node", "run", "f", *(["up"] if with_up else [])).mapInArrow(run, f"node {node}, run int, at int, value double")
    out: dict[tuple, list] = {}
    for r in parts.groupBy("node", "run").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("x")).selectExpr("node", "run", "transform(x, y -> y.at) AS at", "transform(x, y -> y.value) AS value").collect():
        out[r["node"], r["run"]] = np.bincount(r["at"], r["value"])
    return out


def blocks_of(sizes: list[int]) -> list[slice]:
    ends = np.cumsum(sizes).tolist()
    return [slice(e - s, e) for s, e in zip(sizes, ends, strict=True)]


def _grams(blocks: list[slice]) -> Callable[..., np.ndarray]:
    return lambda f, up: np.concatenate([*((f[:, b].T @ f[:, b]).ravel() for b in blocks), *([[(f[:, b] * up[:, b]).sum()] for b in blocks] if up is not None and up.shape[1] == f.shape[1] else [[0.0] for _ in blocks])])


def _unpacked(values: dict[tuple, np.ndarray], sizes: list[int]) -> Small:
    """Square matrices of the given sizes, and one number for each behind them."""
    cuts = np.cumsum([s * s for s in sizes])
    return {k: [*(p.reshape(s, s) for p, s in zip(np.split(v[: cuts[-1]], cuts[:-1]), sizes, strict=True)), v[cuts[-1] :]] for k, v in values.items()}


def fit_all(cells: DataFrame, ranks: list[int], rounds: int = 12, inner: int = 10, seed: int = 7) -> tuple[DataFrame, DataFrame, dict[tuple, np.ndarray]]:
    """w (node, run, i, f), h (node, run, j, f) and the relative errors of each node and run, by rank, for cells (node, run, i, j, v).

    Multiplicative updates for the squared error; a half round takes ``inner`` of them against
    the same product of cells and other factor.
    """
    blocks, width = blocks_of(ranks), sum(ranks)

    def rule(grams: list[np.ndarray], f: np.ndarray, up: np.ndarray) -> np.ndarray:
        f = f.copy()
        for b, gram in zip(blocks, grams, strict=False):
            own = f[:, b]
            for _ in range(inner):
                own = own * up[:, b] / (own @ gram + TINY)
            f[:, b] = np.maximum(own, TINY)
        return f

    w, h = start(cells, "i", width, seed), start(cells, "j", width, seed + 1)
    of_w = _unpacked(reduced(w, _grams(blocks)), ranks)
    for _ in range(rounds):
        h = stepped(h, "j", contracted(cells, "j", w, "i", width), width, of_w, rule)
        of_h = _unpacked(reduced(h, _grams(blocks)), ranks)
        w = stepped(w, "i", contracted(cells, "i", h, "j", width), width, of_h, rule)
        of_w = _unpacked(reduced(w, _grams(blocks)), ranks)
    size = {(r["node"], r["run"]): r["xx"] for r in cells.groupBy("node", "run").agg(F.sum(F.col("v") * F.col("v")).alias("xx")).collect()}
    errors = {}
    for key, xx in size.items():
        model = np.array([(a * b).sum() for a, b in zip(of_w[key][:-1], of_h[key][:-1], strict=True)])
        errors[key] = np.sqrt(np.maximum(xx - 2 * of_w[key][-1] + model, 0) / max(xx, TINY))
    return w.drop("up"), h.drop("up"), errors


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row of a cost table (rows at most columns) its column in the assignment of least total cost: shortest augmenting paths."""
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for new in range(n):
        least, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, so_far = new, -1, 0.0
        visited = []
        while True:
            reach = so_far + cost[row] - row_price[row] - column_price
            better = ~done & (reach < least)
            least[better], came[better] = reach[better], column
            column = int(np.argmin(np.where(done, np.inf, least)))
            so_far = least[column]
            done[column] = True
            visited.append(column)
            if owner[column] < 0:
                break
            row = owner[column]
        row_price[new] += so_far
        for c in visited[:-1]:
            row_price[owner[c]] += so_far - least[c]
            column_price[c] += least[c] - so_far
        while column >= 0:
            before = came[column]
            owner[column] = owner[before] if before >= 0 else new
            column = before
    out = np.empty(n, int)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def judged(products: np.ndarray, k: int, runs: int, distance: str = "angle") -> tuple[np.ndarray, np.ndarray]:
    """Which column of each run belongs to which cluster, (runs, k), and silhouettes (k, runs), from inner products of all columns (run by run).

    Centres are means of unit columns, matched to each run's columns by optimal assignment.
    ``hamming`` measures distances of 0/1 columns by the places in which they differ.
    """
    size = np.sqrt(np.maximum(np.diag(products), TINY))
    near = np.clip(products / size / size[:, None], -1, 1)
    order = np.tile(np.arange(k), (runs, 1)) + k * np.arange(runs)[:, None]
    for turn in range(100):
        members = order[:1] if turn == 0 else order
        centre = np.stack([near[members[:, c]].sum(0) / max(np.sqrt(near[np.ix_(members[:, c], members[:, c])].sum()), TINY) for c in range(k)])
        new = np.stack([r * k + assign(-centre[:, r * k : (r + 1) * k]) for r in range(runs)])
        if turn and (new == order).all():
            break
        order = new
    if k == 1:
        return order, np.ones((1, runs))
    flat = order.T.ravel()  # cluster by cluster
    if distance == "hamming":
        ones = np.diag(products)
        apart = ones[:, None] + ones - 2 * products
    else:
        apart = np.arccos(near)
    mean = apart[np.ix_(flat, flat)].reshape(k, runs, k, runs).mean(3)
    own = mean[np.arange(k), :, np.arange(k)] * runs / max(runs - 1, 1)
    other = np.where(np.eye(k, dtype=bool)[:, None], np.inf, mean).min(2)
    return order, (other - own) / np.maximum(np.maximum(own, other), TINY)


def stability(rows: DataFrame, key: str, sizes: list[int], distance: str = "angle") -> DataFrame:
    """node, block, least, mean: silhouettes of the clustered columns of runs 1 and up, for every block of the factor.

    Columns are compared by their inner products, summed over the factor's rows by Spark.
    """
    blocks, node = blocks_of(sizes), rows.schema["node"].dataType.simpleString()
    packed = rows.where("run > 0").groupBy("node", key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run", "f"))), lambda x: x.f)).alias("f"))
    width = sum(sizes)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            if n := batch.num_rows:
                f = _numbers(batch.column("f"), n).reshape(n, -1, width)
                codes, names = pd.factorize(np.array(batch.column("node").to_pylist(), object))
                for c, name in enumerate(names):
                    own = f[codes == c]
                    for b, place in enumerate(blocks):
                        flat = own[:, :, place].reshape(len(own), -1)
                        found[name, b] = found.get((name, b), 0) + flat.T @ flat
        for (name, b), p in found.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"node": [name] * p.size, "block": np.int32(b), "at": np.arange(p.size, dtype=np.int32), "value": p.ravel()}), preserve_index=False)

    sums = packed.select("node", "f").mapInArrow(products, f"node {node}, block int, at int, value double").groupBy("node", "block", "at").agg(F.sum("value").alias("value"))

    def judge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("at")["value"].to_numpy()
        side = int(round(len(values) ** 0.5))
        k = sizes[int(key[1])]
        s = judged(values.reshape(side, side), k, side // k, distance)[1].mean(1)
        return pd.DataFrame({"node": [key[0]], "block": [key[1]], "least": [float(s.min())], "mean": [float(s.mean())]})

    return written(sums.groupBy("node", "block").applyInPandas(judge, f"node {node}, block int, least double, mean double"))


def with_choice(table: DataFrame, threshold: float, lowered: bool = True) -> DataFrame:
    """selected: of a node's rows the largest rank with ``stable`` of at least the threshold, which is lowered to the best one seen where none has it."""
    own = Window.partitionBy("node")
    limit = F.least(F.lit(threshold), F.max("stable").over(own)) if lowered else F.lit(threshold)
    return table.withColumn("_ok", F.col("stable") >= limit).withColumn("selected", F.coalesce(F.col("rank") == F.max(F.when(F.col("_ok"), F.col("rank"))).over(own), F.lit(False))).drop("_ok")


def select_ranks(cells: DataFrame, ranks: list[int], runs: int = 8, noise: str = "uniform", epsilon: float | tuple[float, float] = 0.03, rounds: int = 12, threshold: float = 0.8, lowered: bool = True, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Table (node, rank, stable, mean_w, mean_h, error, selected) and the unperturbed factors w and h, for the cells (node, i, j, v) of every node.

    stable is the smallest mean silhouette of a cluster, of w or of h; error that of the unperturbed fit.
    Without ``lowered`` a node in which no rank reaches the threshold has no selected one.
    """
    ranks = sorted(set(ranks))
    copies = perturbed(cells, runs, noise, epsilon, seed)
    w, h, errors = fit_all(copies, ranks, rounds, seed=seed)
    bits = noise == "boolean"
    sides = [stability(as_bits(f, key, ranks) if bits else f, key, ranks, "hamming" if bits else "angle").select("node", "block", F.col("least").alias(f"least_{s}"), F.col("mean").alias(f"mean_{s}")) for f, key, s in ((w, "i", "w"), (h, "j", "h"))]
    spark, node = cells.sparkSession, cells.schema["node"].dataType.simpleString()
    told = spark.createDataFrame([(k[0], b, ranks[b], float(e)) for k, errs in errors.items() if k[1] == 0 for b, e in enumerate(errs)], f"node {node}, block int, rank int, error double")
    table = told.join(sides[0], ["node", "block"]).join(sides[1], ["node", "block"]).withColumn("stable", F.least("least_w", "least_h"))
    return written(with_choice(table, threshold, lowered).select("node", "rank", "stable", "mean_w", "mean_h", "error", "selected")), w.where("run = 0").drop("run"), h.where("run = 0").drop("run")


def as_bits(factor: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """The factor with 1 where a value is over half of its column's largest, else 0 (columns of each node and run)."""
    width = sum(sizes)
    top = factor.groupBy("node", "run").agg(F.array(*(F.max(F.col("f")[a]) for a in range(width))).alias("top"))
    return factor.join(F.broadcast(top), ["node", "run"]).select("node", "run", key, F.zip_with("f", "top", lambda x, t: (x > t / 2).cast("double")).alias("f"))


def symmetric_fit(cells: DataFrame, ranks: list[int], rounds: int = 15, seed: int = 7) -> tuple[DataFrame, list[dict[tuple, np.ndarray]]]:
    """w (node, run, i, f) with x about w w' for symmetric cells (node, run, i, j, v), and the objectives |x - w w'|^2 of each round.

    Projected Newton: rows move along the Newton direction of their free entries (those not
    held at 0 by the gradient), and of several step lengths the first that lowers the
    objective enough (Armijo) is taken.  All lengths are tried in one pass over the cells,
    whose product for the chosen one is what the next round starts from.
    """
    blocks, width, tries = blocks_of(ranks), sum(ranks), len(STEPS)
    wide = blocks_of([k for _ in STEPS for k in ranks])
    xx = {(r["node"], r["run"]): r["xx"] for r in cells.groupBy("node", "run").agg(F.sum(F.col("v") * F.col("v")).alias("xx")).collect()}
    diagonal = cells.where("i = j").select("node", "run", "i", F.col("v").alias("own"))

    def direction(f: np.ndarray, product: np.ndarray, own: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gradient = 4 * (f @ gram - product)
        free = (f > TINY) | (gradient < 0)
        square = (f * f).sum(1)
        hessian = 4 * (gram[None] + f[:, :, None] * f[:, None, :]) + (4 * np.maximum(square - own, 0) + 1e-9 + 1e-6 * np.trace(gram))[:, None, None] * np.eye(f.shape[1])
        both = free[:, :, None] & free[:, None, :]
        hessian = np.where(both, hessian, 0.0) + np.where(free, 0.0, 1.0)[:, :, None] * np.eye(f.shape[1])
        return -np.linalg.solve(hessian, np.where(free, gradient, 0.0)[:, :, None])[:, :, 0], gradient

    def trial(small: list[np.ndarray], f: np.ndarray, up: np.ndarray) -> np.ndarray:
        """The row at every step length, then the row itself, its product and its diagonal cell."""
        moved, product, own = [], up[:, :width], up[:, width]
        for s in STEPS:
            for b, gram in zip(blocks, small, strict=False):
                step, _ = direction(f[:, b], product[:, b], own, gram)
                moved.append(np.maximum(f[:, b] + s * step, 0))
        return np.concatenate([*moved, f, up], 1)

    def gains(f: np.ndarray, up: np.ndarray | None) -> np.ndarray:
        """Gram matrices at every step length, inner products with their product, and gradient times the way gone (but for the Gram part)."""
        now, product = f[:, tries * width : (tries + 1) * width], f[:, (tries + 1) * width : (tries + 2) * width]
        out = [(f[:, p].T @ f[:, p]).ravel() for p in wide]
        out += [[(f[:, p] * up[:, p]).sum()] for p in wide]
        out += [[((f[:, p] - now[:, b]) * product[:, b]).sum()] for p, b in zip(wide, blocks * tries, strict=True)]
        out += [((f[:, p] - now[:, b]).T @ now[:, b]).ravel() for p, b in zip(wide, blocks * tries, strict=True)]
        return np.concatenate(out)

    w = start(cells, "i", width, seed)
    # a scale at which w w' has the size of x to begin with
    product = contracted(cells, "i", w.withColumnRenamed("i", "j"), "j", width)
    w = stepped(w, "i", product, width, {k: [] for k in xx}, lambda _, f, up: f)
    first = _unpacked(reduced(w, _grams(blocks)), ranks)
    scale = {k: [np.repeat([np.sqrt(max(v[-1][b], TINY) / max((v[b] ** 2).sum(), TINY)) for b in range(len(ranks))], ranks)] for k, v in first.items()}
    w = stepped(w.drop("up"), "i", w.select("node", "run", "i", "up"), width, scale, lambda s, f, up: np.concatenate([f * s[0], up * s[0]], 1))
    w = w.select("node", "run", "i", F.slice("f", 1, width).alias("f"), F.slice("f", width + 1, width).alias("product"))
    grams, objective = {}, {}
    for k, v in first.items():
        s = [np.sqrt(max(v[-1][b], TINY) / max((v[b] ** 2).sum(), TINY)) for b in range(len(ranks))]
        grams[k] = [v[b] * s[b] ** 2 for b in range(len(ranks))]
        objective[k] = np.array([xx[k] - 2 * v[-1][b] * s[b] ** 2 + (grams[k][b] ** 2).sum() for b in range(len(ranks))])
    told = [objective]
    w = written(w.join(diagonal, ["node", "run", "i"], "left").withColumn("own", F.coalesce("own", F.lit(0.0))))
    for _ in range(rounds):
        known = w.select("node", "run", "i", F.concat("product", F.array("own")).alias("up"))
        tried = stepped(w, "i", known, width + 1, grams, trial).drop("up")
        moved = tried.select("node", "run", F.col("i").alias("j"), F.slice("f", 1, tries * width).alias("f"))
        tried = written(tried.join(contracted(cells, "i", moved, "j", tries * width), ["node", "run", "i"], "left").withColumn("up", F.coalesce("up", F.array_repeat(F.lit(0.0), tries * width))))
        values, chosen, new_grams, new_objective = reduced(tried, gains), {}, {}, {}
        squares = [k * k for _ in STEPS for k in ranks]
        for key, v in values.items():
            at = np.cumsum([sum(squares), len(wide), len(wide)])
            gram, inner, way, turn = np.split(v, at)
            gram, turn = np.split(gram, np.cumsum(squares)[:-1]), np.split(turn, np.cumsum(squares)[:-1])
            chosen[key], new_grams[key], new_objective[key] = [], [], objective[key].copy()
            for b, k in enumerate(ranks):
                take, kept = -1, grams[key][b]
                for t in range(tries):
                    p = t * len(ranks) + b
                    own = gram[p].reshape(k, k)
                    value = xx[key] - 2 * inner[p] + (own**2).sum()
                    slope = 4 * ((turn[p].reshape(k, k) * grams[key][b]).sum() - way[p])
                    if value <= objective[key][b] + 0.1 * min(slope, 0.0):
                        take, kept, new_objective[key][b] = t, own, value
                        break
                chosen[key].append(take)
                new_grams[key].append(kept)

        def pick(small: list[int], f: np.ndarray, up: np.ndarray) -> np.ndarray:
            rows, products = [], []
            for b, t in zip(blocks, small, strict=True):
                old = slice(tries * width + b.start, tries * width + b.stop)
                new = slice(t * width + b.start, t * width + b.stop)
                rows.append(f[:, new] if t >= 0 else f[:, old])
                products.append(up[:, new] if t >= 0 else f[:, width + old.start : width + old.stop])
            return np.concatenate([*rows, *products, f[:, -1:]], 1)

        w = stepped(tried.drop("up"), "i", tried.select("node", "run", "i", "up"), tries * width, chosen, pick)
        w = w.select("node", "run", "i", F.slice("f", 1, width).alias("f"), F.slice("f", width + 1, width).alias("product"), F.element_at("f", -1).alias("own"))
        grams, objective = new_grams, new_objective
        told.append(objective)
        if all(t < 0 for c in chosen.values() for t in c):
            break
    return w.select("node", "run", "i", "f"), told


def select_ranks_symmetric(cells: DataFrame, ranks: list[int], runs: int = 6, epsilon: float = 0.03, rounds: int = 15, threshold: float = 0.8, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """As select_ranks for symmetric cells (node, i, j, v), both (i, j) and (j, i) given: table (node, rank, stable, mean_w, error, selected) and w."""
    ranks = sorted(set(ranks))
    upper = perturbed(cells.where("i <= j"), runs, "uniform", epsilon, seed)
    copies = written(upper.unionByName(upper.where("i < j").select("node", "run", F.col("j").alias("i"), F.col("i").alias("j"), "v")))
    w, told = symmetric_fit(copies, ranks, rounds, seed)
    xx = {r["node"]: r["xx"] for r in copies.where("run = 0").groupBy("node").agg(F.sum(F.col("v") * F.col("v")).alias("xx")).collect()}
    spark, node = cells.sparkSession, cells.schema["node"].dataType.simpleString()
    errors = spark.createDataFrame([(k[0], b, ranks[b], float(np.sqrt(max(o, 0) / max(xx[k[0]], TINY)))) for k, v in told[-1].items() if k[1] == 0 for b, o in enumerate(v)], f"node {node}, block int, rank int, error double")
    table = errors.join(stability(w, "i", ranks), ["node", "block"]).select("node", "rank", F.col("least").alias("stable"), F.col("mean").alias("mean_w"), "error")
    return written(with_choice(table, threshold)), w.where("run = 0").drop("run")


def three_factor_fit(cells: DataFrame, pairs: list[tuple[int, int]], rounds: int = 25, inner: int = 5, alpha: float = 0.0, seed: int = 7) -> tuple[DataFrame, DataFrame, Small, dict[tuple, np.ndarray]]:
    """w (node, run, i, f), h (node, run, j, f), middle matrices s of each node and run, and relative errors, with x about w s h for every pair of ranks.

    w starts as that of a two-factor fit of the first rank, h as that of the second.

    ``alpha`` draws the columns of w and the rows of h apart, so that they name groups.
    """
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    in_w, in_h = blocks_of(left), blocks_of(right)
    ranks = sorted({*left, *right})
    w, h, _ = fit_all(cells, ranks, rounds, inner, seed)
    place = dict(zip(ranks, blocks_of(ranks), strict=True))
    beside = lambda own: F.concat(*(F.slice("f", place[k].start + 1, k) for k in own)).alias("f")
    w, h = written(w.select("node", "run", "i", beside(left))), written(h.select("node", "run", "j", beside(right)))
    keys = [tuple(r) for r in cells.select("node", "run").distinct().collect()]
    middle: Small = {k: [np.ones(p) for p in pairs] for k in keys}

    def rule(own: list[slice], other: list[slice]) -> Callable[..., np.ndarray]:
        def run(small: list[np.ndarray], f: np.ndarray, up: np.ndarray) -> np.ndarray:
            f = f.copy()
            for b, o, (s, gram, apart) in zip(own, other, small, strict=True):
                rows, target, square = f[:, b], up[:, o] @ s.T, s @ gram @ s.T
                for _ in range(inner):
                    rows = rows * (target + 2 * alpha * rows) / (rows @ (square + 2 * alpha * apart) + TINY)
                f[:, b] = np.maximum(rows, TINY)
            return f

        return run

    def sums(own: list[slice], other: list[slice]) -> Callable[..., np.ndarray]:
        return lambda f, up: np.concatenate([*((f[:, b].T @ f[:, b]).ravel() for b in own), *((f[:, b].T @ up[:, o]).ravel() for b, o in zip(own, other, strict=True))])

    grams = _unpacked(reduced(w, lambda f, up: np.concatenate([(f[:, b].T @ f[:, b]).ravel() for b in in_w])), left)
    of_h = _unpacked(reduced(h, lambda f, up: np.concatenate([(f[:, b].T @ f[:, b]).ravel() for b in in_h])), right)
    errors: dict[tuple, np.ndarray] = {}
    xx = {(r["node"], r["run"]): r["xx"] for r in cells.groupBy("node", "run").agg(F.sum(F.col("v") * F.col("v")).alias("xx")).collect()}

    def settle(rows: DataFrame, steps: int) -> None:
        """Gram matrices of w, middle matrices and errors, from rows of w with their product."""
        for key, v in reduced(rows, sums(in_w, in_h)).items():
            cut = sum(a * a for a in left)
            grams[key] = _unpacked({key: v[:cut]}, left)[key][:-1]
            crossed, errs = np.split(v[cut:], np.cumsum([a * b for a, b in pairs])[:-1]), []
            for n, (p, c) in enumerate(zip(pairs, crossed, strict=True)):
                c, s = c.reshape(p), middle[key][n]
                for _ in range(steps):
                    s = s * c / np.maximum(grams[key][n] @ s @ of_h[key][n], TINY)
                middle[key][n] = s
                errs.append(xx[key] - 2 * (c * s).sum() + ((grams[key][n] @ s) * (s @ of_h[key][n])).sum())
            errors[key] = np.sqrt(np.maximum(errs, 0) / max(xx[key], TINY))

    same = {k: [] for k in keys}
    settle(stepped(w, "i", contracted(cells, "i", h, "j", sum(right)), sum(right), same, lambda _, f, up: f), 300)
    for _ in range(rounds):
        small = {k: [(m.T, g, a) for m, g, a in zip(middle[k], grams[k], of_h[k], strict=False)] for k in keys}
        h = stepped(h, "j", contracted(cells, "j", w, "i", sum(left)), sum(left), small, rule(in_h, in_w))
        of_h = _unpacked(reduced(h.drop("up"), lambda f, up: np.concatenate([(f[:, b].T @ f[:, b]).ravel() for b in in_h])), right)
        small = {k: [(m, g, a) for m, g, a in zip(middle[k], of_h[k], grams[k], strict=False)] for k in keys}
        w = stepped(w, "i", contracted(cells, "i", h, "j", sum(right)), sum(right), small, rule(in_w, in_h))
        settle(w, inner)
    return w.drop("up"), h.drop("up"), middle, errors


def select_ranks_three(cells: DataFrame, left: list[int], right: list[int], runs: int = 6, epsilon: float = 0.03, rounds: int = 25, threshold: float = 0.8, alpha: float = 0.0, seed: int = 7) -> DataFrame:
    """node, k1, k2, stable, error, selected over a grid of two ranks: both factors are clustered over the perturbed runs.

    Selected is the stable pair of most topics in all (k1 + k2, then k1), with the threshold lowered to the best pair where none has it.
    """
    pairs = [(a, b) for a in sorted(set(left)) for b in sorted(set(right))]
    w, h, _, errors = three_factor_fit(perturbed(cells, runs, "uniform", epsilon, seed), pairs, rounds, alpha=alpha, seed=seed)
    node = cells.schema["node"].dataType.simpleString()
    told = cells.sparkSession.createDataFrame([(k[0], n, *pairs[n], sum(pairs[n]) * 1000 + pairs[n][0], float(e)) for k, v in errors.items() if k[1] == 0 for n, e in enumerate(v)], f"node {node}, block int, k1 int, k2 int, rank int, error double")
    both = stability(w, "i", [a for a, _ in pairs]).select("node", "block", F.col("least").alias("a")).join(stability(h, "j", [b for _, b in pairs]).select("node", "block", F.col("least").alias("b")), ["node", "block"])
    return written(with_choice(told.join(both, ["node", "block"]).withColumn("stable", F.least("a", "b")), threshold).select("node", "k1", "k2", "stable", "error", "selected"))
