import tempfile

import pytest

from textloom.operators import search as S
from textloom.plans.search_queries import paper_rows

SMALL = "/root/testdata/sf0.001"
CASES = [
    dict(queries=["the"]),
    dict(queries=["the and", "die und"], match_all=False),
    dict(queries=[{"the": ["+and", "of"]}, "that"], linked=True),
    dict(queries=["the", "of"], match_all=True, filters={"country": ["Spain", ""], "author": ["a3", "A5"]}),
    dict(filters={"year": [1995, 2003]}),
    dict(filters={"year": []}),
    dict(queries=["no-such-word"]),
    dict(),
]


@pytest.fixture(scope="module")
def saved(spark):
    papers = paper_rows(spark, SMALL).cache()
    folder = tempfile.mkdtemp(prefix="spark-index-", dir="/tmp") + "/index"
    S.save_index(S.build_index(papers), folder)
    return papers, S.saved_index(spark, folder)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_lookup_equals_search(saved, case):
    papers, index = saved
    assert ids(S.look_up(index, **case)) == ids(S.search(papers, **case))


@pytest.mark.parametrize("ordered", [True, False])
def test_windows_look_at_the_papers_found(saved, ordered):
    papers, index = saved
    case = dict(queries=["the of"], window=3, ordered=ordered)
    assert ids(S.search_saved(index, papers, **case)) == ids(S.search(papers, **case)) != []


def test_lookup_reads_its_kinds_alone(saved):
    plan = S.look_up(saved[1], filters={"year": [1995]})._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan or "(kind" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "value" in plan.split("PushedFilters:")[1].split("]")[0]
