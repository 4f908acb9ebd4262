import numpy as np
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.functions import words as W
from textloom.graph import paths
from textloom.operators import entities, factor, hierarchy


def brute(edges):
    """Distances and numbers of shortest paths by breadth-first search."""
    nodes = sorted({x for e in edges for x in e})
    out = {}
    for s in nodes:
        level, d = {s: 1}, 0
        while level:
            out |= {(s, v): (d, c) for v, c in level.items()}
            new = {}
            for a, b in set(edges):
                if a in level and (s, b) not in out:
                    new[b] = new.get(b, 0) + level[a]
            level, d = new, d + 1
    return nodes, out


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (2, 4), (7, 1), (8, 8), (1, 2)]


def test_paths_closeness_betweenness(spark):
    frame = spark.createDataFrame(EDGES, "src long, dst long")
    nodes, want = brute(EDGES)
    assert {(r["source"], r["node"]): (r["distance"], int(r["paths"])) for r in paths.shortest_paths(frame).collect()} == want
    n, through, near = len(nodes), dict.fromkeys(nodes, 0.0), {}
    for v in nodes:
        d = [want[s, v][0] for s in nodes if (s, v) in want and s != v]
        near[v] = len(d) / sum(d) * len(d) / (n - 1) if d else 0.0
        for s in nodes:
            for t in nodes:
                if len({s, t, v}) == 3 and all(p in want for p in ((s, v), (v, t), (s, t))) and want[s, v][0] + want[v, t][0] == want[s, t][0]:
                    through[v] += want[s, v][1] * want[v, t][1] / want[s, t][1] / ((n - 1) * (n - 2))
    assert {r["node"]: r["closeness"] for r in paths.closeness(frame).collect()} == pytest.approx(near)
    assert {r["node"]: r["betweenness"] for r in paths.betweenness(frame).collect()} == pytest.approx(through)


def test_strong_components_and_nothing(spark):
    frame = spark.createDataFrame(EDGES, "src long, dst long")
    assert {r["node"]: r["component"] for r in paths.strong_components(frame).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    none = frame.where("false")
    assert [f(none).count() for f in (paths.closeness, paths.betweenness, paths.strong_components)] == [0, 0, 0]


def test_acronyms_and_substitutions(spark):
    rows = spark.createDataFrame([(["support", "vector", "machine", "svm", "x"],), (["nmf", "nonnegative", "matrix", "factors"],), ([],), (["a"],)], "w array<string>")
    found = [[tuple(x) for x in r[0]] for r in rows.select(W.acronyms(F.col("w"))).collect()]
    assert found == [[("svm", "support vector machine")], [("nmf", "nonnegative matrix factors")], [], []]
    step = W.substitute({"a b": "a_b", "b": "$c", "d": "d"})
    assert [r[0] for r in spark.createDataFrame([("a b b b d",), ("",), (None,), ("ab a\nb",)], "t string").select(step(F.col("t"))).collect()] == ["a_b $c $c d", "", None, "ab a\n$c"]
    with pytest.raises(ValueError):
        W.substitute({"a": "b", "b": "c"})
    words = {"studies": "study", "running": "runn", "cats": "cat", "is": "is", "rationalization": "rationalize"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", W.stem(F.col("w"))).collect()} == words


def test_acronyms_look_at_each_place_once(spark):
    import random
    import time

    def by_hand(words):
        out = []
        for n in range(2, 8):
            for word, start in ((-1, 1), (n, 0)):
                for i in range(len(words)):
                    run, at = words[i + start : i + start + n], i + n if start == 0 else i
                    if len(run) == n and at < len(words) and words[at] == "".join(w[0] for w in run):
                        out.append((words[at], " ".join(run)))
        return list(dict.fromkeys(out))

    draw = random.Random(3)
    texts = [["".join(draw.choice("abé") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(0, 60))] for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "w array<string>").select("w", W.acronyms(F.col("w")).alias("a")).collect()
    assert all([tuple(x) for x in r["a"]] == by_hand(r["w"]) for r in rows) and sum(len(r["a"]) for r in rows) > 50
    long = spark.createDataFrame([(["w%d" % i for i in range(300_000)] + ["ww"],), (None,), ([],)], "w array<string>")
    began = time.time()
    assert [len(r[0] or []) for r in long.select(W.acronyms(F.col("w"))).collect()] == [1, 0, 0]
    assert time.time() - began < 15


def test_authors(spark):
    left = spark.createDataFrame([(1, 1, "Doe, Jane"), (2, 1, "Doe, Jane"), (1, 2, "Roe, A."), (3, 3, None)], "paper int, id long, name string")
    right = spark.createDataFrame([(1, 11, "jane doe"), (2, 11, "Jane Doe"), (2, 12, "Jane Dow"), (1, 13, "A Roe"), (3, 14, "")], "paper int, id long, name string")
    assert {(r["left_id"], r["right_id"], r["papers"]) for r in entities.match_authors(left, right).collect()} == {(1, 11, 2), (2, 13, 1)}
    rows = [(1, 1, "A B"), (1, 8, "x"), (1, 9, "y"), (2, 2, "B, A"), (2, 8, "x"), (2, 9, "y"), (3, 3, "a b"), (3, 1, "A B"), (3, 8, "x"), (3, 9, "y")]
    pairs = entities.possible_duplicates(spark.createDataFrame(rows, "paper int, id long, name string"))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (2, 3)}
    names = spark.createDataFrame([(1, "A"), (2, "Abe"), (3, None), (4, "Z")], "id long, name string")
    assert {tuple(r) for r in entities.unified_ids(pairs, names).collect()} == {(1, 1, "Abe"), (2, 1, "Abe"), (3, 1, "Abe"), (4, 4, "Z")}
    lists = spark.createDataFrame([(2, "1;2", "Old;B"), (1, "1; ;3", "New;;C"), (3, None, None)], "paper int, author_ids string, authors string")
    assert {tuple(r) for r in entities.id_names(lists).collect()} == {("1", "New"), ("2", "B"), ("3", "C")}


def test_kernels():
    draw = np.random.default_rng(3)
    w, h = draw.random((20, 3)), draw.random((3, 25))
    assert factor.relative_error(w @ h, *factor.nmf_admm(w @ h, draw.random((20, 3)), draw.random((3, 25)), 3000)) < 1e-2
    a, b = np.kron(np.eye(3), np.ones((6, 1))), np.kron(np.eye(3), np.ones((1, 7)))
    x = a @ b
    fit = factor.boolean_nmf(np.where(draw.random(x.shape) < 0.1, np.nan, x), draw.random(a.shape), draw.random(b.shape))
    assert ((fit[0] @ fit[1] > 0.5) == (x > 0.5)).mean() > 0.95
    assert 1 < factor.otsu_threshold(np.array([0.1, 0.2, 0.1, 3.0, 3.1])) < 2 and factor.otsu_threshold(np.array([2.0, 2.0])) == 2.0
    assert factor.relative_error(w[:, :1] @ h[:1], *factor.svd_start(w[:, :1] @ h[:1], 1)) < 1e-9


def test_topic_tree_splits_blocks(spark):
    cells = [(i, j, 1.0) for i in range(40) for j in range(12) if i // 10 == j // 3]
    leaf = {r["i"]: r["node"] for r in hierarchy.topic_tree(spark.createDataFrame(cells, "i int, j int, v double"), rank=2, depth=2, least=15, rounds=25).collect()}
    blocks = [{leaf[i] for i in range(10 * b, 10 * b + 10)} for b in range(4)]
    assert len(leaf) == 40 and all(len(x) == 1 for x in blocks) and len(set.union(*blocks)) >= 2


def test_consensus_of_few_rows(spark):
    rows = [(r, i, label) for r, labels in enumerate(["aabb", "aaab"]) for i, label in enumerate(labels)]
    assert {tuple(r) for r in hierarchy.co_assignment(spark.createDataFrame(rows, "run int, i int, label string")).collect()} == {(1.0, 1), (0.5, 3), (0.0, 2)}


def test_rating_and_logistic_models(spark):
    draw = np.random.default_rng(4)
    x = 3 + draw.random((12, 2)) @ draw.random((2, 10))
    frame = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(10)], "i int, j int, v double")
    mean, users, items = hierarchy.recommender(frame, rank=2, rounds=12, rate=0.02)
    error = hierarchy.predict_ratings(frame, mean, users, items).agg(F.sqrt(F.avg((F.col("guess") - F.col("v")) ** 2))).first()[0]
    assert error < float(x.std())
    losses = hierarchy.logistic_factors(frame.withColumn("v", (F.col("v") > mean).cast("int")), rank=2, rounds=8, rate=1.0)[2]
    assert losses[-1] < losses[0]


def odd_documents(spark, folder):
    """Repeated and missing ids, missing texts, white space of all kinds: some of it parts no words."""
    texts = ["A a\tB\n\nc", "b c d É é", None, "", "  ", "c d e f", "x a ß", "a b c d e f g h", "c d g h", "e f g h a"]
    rows = [(None if k % 11 == 7 else k % 23, texts[k % len(texts)]) for k in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_tf_idf_of_odd_documents_moves_texts_once(spark, tmp_path):
    import duckdb
    from oracle import sorted_rows

    from textloom.plans.queries import ORACLE, QUERIES

    folder = odd_documents(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, told = QUERIES["tf_idf"](spark, folder), con.execute(ORACLE["tf_idf"])
    names = [x[0] for x in told.description]
    expected = told.fetchall()
    assert len(expected) > 50 and sorted_rows(got.columns, got.collect()) == sorted_rows(names, expected)
    assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_term_rules_of_odd_documents_count_no_pairs(spark, tmp_path):
    import duckdb
    from oracle import sorted_rows

    from textloom.operators import text
    from textloom.plans.queries import ORACLE, QUERIES

    folder = odd_documents(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, told = QUERIES["term_rules"](spark, folder), con.execute(ORACLE["term_rules"])
    names = [x[0] for x in told.description]
    expected = told.fetchall()
    assert expected and sorted_rows(got.columns, got.collect()) == sorted_rows(names, expected)
    assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()
    many = [(["t"], [f"{k}", "t", "u"]) for k in range(50)]
    held = list(text.shared_words(iter([text.pa.RecordBatch.from_pydict({"top": [m[0] for m in many], "tokens": [m[1] for m in many]})]), most=20))
    assert sum(sum(b.column("n").to_pylist()) for b in held) == 50 and all({"t", "u"} <= set(x) for b in held for x in b.column("tokens").to_pylist())


def test_factorizations_leave_no_tables_of_earlier_steps(spark, monkeypatch):
    from textloom import shared

    at = lambda df: df.inputFiles()[0].rsplit("/", 1)[0].split("file:", 1)[-1].replace("///", "/")
    made = []
    keep = shared.written
    monkeypatch.setattr(shared, "written", lambda df: made.append(keep(df)) or made[-1])
    cells = spark.createDataFrame([("0", i, j, 1.0 + (i * j) % 5) for i in range(12) for j in range(9) if (i + j) % 3], "node string, i int, j int, v double")
    few = {}
    for most in (0, shared.MOST_BROADCAST):  # with and without sending h to the tasks
        monkeypatch.setattr(shared, "MOST_BROADCAST", most)
        w, h, error = factor.distributed_nmf(cells.drop("node"), 2, 4)
        gw, gh = hierarchy.grouped_nmf(cells, 2, 4)
        few[most] = [sorted((r[k], *(round(x, 6) for x in r[f])) for r in df.collect()) for df, k, f in ((w, "i", "w"), (h, "j", "h"), (gw, "i", "w"), (gh, "j", "h"))]
        assert 0 < error < 1
    assert few[0] == few[shared.MOST_BROADCAST]
    assert len(made) >= 32 and sum(Path(at_).exists() for at_ in {at(df) for df in made if df.inputFiles()}) <= 8
