import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import words as W
from textloom.operators import reports, search, tensor, vectors
from textloom.sources import rules

PAPERS = [
    (1, "alpha beta", "gamma delta alpha", 2000, "A1; b2;", [("f1", "Inst", "Spain", ["a1"])]),
    (2, "alpha", "beta epsilon", 2005, "b2", [("f2", "Lab", None, ["b2"])]),
    (3, None, None, None, None, None),
    (4, "Alpha gamma", "zeta", 2010, "c3; ;a1", []),
]
SCHEMA = "id long, title string, abstract string, year int, author_ids string, affiliations array<struct<id:string,name:string,country:string,authors:array<string>>>"


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(PAPERS, SCHEMA)


def ids(df):
    return {r["id"] for r in df.collect()}


def test_search_stages(papers):
    assert ids(search.search(papers)) == set()
    assert ids(search.search(papers, "alpha")) == {1, 2, 4}
    # a negative of the title does not take a match of the abstract, one of the abstract does
    assert ids(search.search(papers, {"alpha": ["beta"]})) == {1, 4}
    assert ids(search.search(papers, {"alpha": ["delta"]})) == {2, 4}
    # a positive of the abstract is asked of title matches too
    assert ids(search.search(papers, {"alpha": ["+zeta"]})) == set()
    assert ids(search.search(papers, {"gamma": ["+delta"]})) == {1}
    assert ids(search.search(papers, ["gamma", "epsilon"], {"year": [2000, 2005]})) == {1, 2}
    assert ids(search.search(papers, None, {"author": ["A1"]})) == {1, 4}
    assert ids(search.search(papers, ["gamma", {"alpha": "delta"}], match_all=True, linked=True)) == {1, 4}
    assert {(r["filter_value"], r["num_papers"]) for r in search.explain(papers, ["alpha", "none"], {"country": ["SPAIN", ""]}).collect()} == {("alpha", 3), ("none", 0), ("SPAIN", 1), ("", 1)}


def test_queries_are_checked():
    assert [q.label for q in search.read_queries(["A b", {"C": ["+D", "e"]}])] == ["a b", "c +d -e"]
    for bad in (3, [3], "", {"a": ["b c"]}):
        with pytest.raises((TypeError, ValueError)):
            search.read_queries(bad)


def test_windows_count_repeated_words(spark):
    rows = spark.createDataFrame([(1, "a x b"), (2, "b a"), (3, "a a b"), (4, "a x x x b"), (5, "a")], "id long, t string")
    hit = lambda words, n, ordered=True: ids(rows.where(search.in_window(search.lower_tokens(F.col("t")), words, n, ordered)))
    assert hit(["a", "b"], 3) == {1, 3} and hit(["a", "b"], 3, False) == {1, 2, 3} and hit(["a", "b"], 5) == {1, 3, 4} and hit(["a", "a", "b"], 3) == {3}


def test_rules_filters_and_tags(papers, spark):
    rows = spark.createDataFrame([(1, "Big data and no tea"), (2, "big-data with coffee"), (3, None)], "id long, text string")
    report = {r["id"]: r for r in search.rule_report(rows, {"big data": {"positives": ["tea", "coffee"], "negatives": ["rum"]}}, negatives=["with"]).collect()}
    assert (report[1]["passed"], report[1]["matched_positives"], report[2]["passed"], report[2]["rule"], report[3]["passed"]) == (True, "tea", False, "big data", False)
    assert ids(papers.where(search.count_between("author_ids", 2))) == {1, 4} and ids(papers.where(search.has_id("author_ids", ["B2"]))) == {1, 2}
    assert ids(papers.where(search.at_affiliation(country="spa"))) == {1} and ids(papers.where(search.year_test("2005-"))) == {2, 4}
    assert ids(search.with_authors_of(papers, search.at_affiliation(ids=["f1"]), lambda a: a["id"] == "f1")) == {1, 4}
    with pytest.raises(ValueError):
        search.year_test("20x5")
    tagged = papers.select("id", search.replace_tag(search.add_tag(F.lit(None).cast("array<string>"), "a"), "a", "b").alias("t")).first()["t"]
    assert tagged == ["b"]
    index = search.bloom(papers.where("id < 3"), "id", 1 << 12)
    assert ids(search.may_be_in(papers, "id", index, 1 << 12).where("maybe")) >= {1, 2}


def test_cleaning_steps(spark):
    one = lambda text, *steps: spark.createDataFrame([(text,)], "t string").select(T.clean(F.col("t"), steps)).first()[0]
    assert one("mix vi civic XIV and", T.pattern_step("remove_roman_numerals")) == "civic  and"
    assert one("a-b the - cat -x y-", T.pattern_step("remove_trailing_dash")) == "a-b the  cat x y"
    assert one("naïve Übung 東京", T.remove_accents) == "naive Ubung 東京"
    assert one("keep x1 not x2 12", T.pattern_step("remove_alphanumeric", ["x1"])) == "keep x1 not  12"
    assert one("state-of-the-art, the end", T.remove_stop_words(["the", "of"])) == "end"
    assert one("state-of-the-art, the end", T.remove_stop_words(["the", "of"], whole=True)) == "state-of-the-art end"
    assert one("(TNF) TNF-x", T.isolate_terms(["TNF"])) == "TNF  TNF x"
    assert one("Keep DNA Lower", T.lower_case(["DNA"])) == "keep DNA lower"
    assert W.expand_substitutions({"Deep Nets": "x"}, {"nets": "net"}) == {"deep nets": "x", "deep-nets": "x", "deep net": "x", "deep-net": "x"}
    with pytest.raises(ValueError):
        W.expand_substitutions({"A b": "x", "a B": "y"})
    row = spark.createDataFrame([("['x']",)], "t string").select(rules.year_range(F.lit("1899"), 2030).alias("y"), rules.affiliations(F.lit("{'Unknown': ['z'], 'i': {'name': 'N', 'country': None, 'authors': ['u']}}")).alias("a")).first()
    assert row["y"]["year"] is None and row["a"]["i"]["name"] == "N" and row["a"]["i"]["country"] is None


def test_nearest_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(100, 0, -1)] + [(200, None), (None, [1.0, 0.0]), (300, [0.0, 0.0])], "vec_id long, embedding array<double>").repartition(3)
    found = vectors.nearest(rows, rows.where("vec_id in (100, 200)"), 3).orderBy("place").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(100, 1), (100, 2), (100, 3)]
    assert vectors.nearest(rows, rows.where("false"), 3).count() == 0 and vectors.nearest(rows.where("false"), rows, 3).count() == 0


def test_numbers_masks_and_areas(spark):
    values = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v long").repartition(5)
    assert sorted((r["v"], r["idx"]) for r in reports.numbered(values, "v").collect()) == [(i, i) for i in range(101)]
    cells = spark.range(1000).selectExpr("id AS row", "id % 3 AS col", "1.0 AS v", "id % 2 AS s")
    assert tensor.sample_mask(cells, 0.255, "s").where("mask = 0").count() == 2 * 127 and tensor.sample_mask(cells, 0.0).where("mask = 0").count() == 0
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, None)], "y int, s double")
    areas = reports.curve_areas(scored, "y", "s").first()
    assert abs(areas["roc_auc"] - 0.875) < 1e-12 and abs(areas["pr_auc"] - (0.5 + 0.5 * (1 + 2 / 3) / 2)) < 1e-12
    assert reports.curve_areas(scored.where("y = 1"), "y", "s").first()["roc_auc"] is None


def test_empty_reports(spark, papers):
    none = spark.createDataFrame([], "paper long, author long, affiliation string, country string, year int, type int, cluster int, citations long")
    for table in (reports.author_table, reports.place_counts, reports.cluster_table, reports.type_summary):
        assert table(none).count() == 0
    assert reports.fuzzy_groups(none, "affiliation").count() == 0 and reports.top_in_cluster(none, "author", 3).count() == 0
    assert search.build_index(papers.where("false")).count() == 0


def test_top_predicted_equals_scores_of_all_pairs(spark):
    from textloom.operators import reports as R

    left = spark.createDataFrame([(r, k, 0.5 + k) for r in range(9) for k in ((r % 3,) if r < 6 else (r % 3, 2))] + [(0, 0, 0.25), (None, 1, 1.5)], "row long, k long, w double")
    right = spark.createDataFrame([(k, c, float((c * (k + 2)) % 7)) for k in range(3) for c in range(12)], "k long, col long, h double")
    bias = spark.createDataFrame([(c, c % 2 / 4) for c in range(0, 12, 3)], "col long, b double")
    known = spark.createDataFrame([(r, c) for r in range(9) for c in range(12) if (r * c) % 4 == 1 or r == 4] + [(1, 1), (1, 99), (None, 3)], "row long, col long")
    whole = R.top_unknown(R.predicted(left, right, col_bias=bias, mean=3.0), known, 4)
    got = R.top_predicted(left, right, known, 4, col_bias=bias, mean=3.0)
    rows = lambda df: sorted((str(r["row"]), r["place"], r["col"], round(r["score"], 9)) for r in df.collect())
    assert rows(got) == rows(whole) and got.where("row = 4").isEmpty() and got.where("row IS NULL").count() == 4


def test_recommendations_make_no_row_for_each_pair(spark):
    from textloom.plans.queries import QUERIES

    plan = QUERIES["recommendations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # columns are put in order once a profile, beforehand
