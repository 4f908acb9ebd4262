"""Queries of paper search and filters, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..shared import stage_folder
from .queries import PAPERS, REFERENCES, papers, query, references, table

COUNTRIES = ("Spain", "France", "New Spain", None)

#: Papers made of documents: first line as title, the rest as abstract, other columns from doc_id.
PAPER_ROWS = (
    "pp AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract, "
    "CASE WHEN doc_id % 11 > 0 THEN 1990 + doc_id % 30 END AS year, 'A' || (doc_id % 17) || '; a' || (doc_id * 7 % 23) || ' ;' AS author_ids, "
    "'f' || (doc_id % 5) AS f1, 'f' || (doc_id * 3 % 7) AS f2, [('Spain'), ('France'), ('New Spain'), NULL][doc_id % 4 + 1] AS c1, [('Spain'), ('France'), ('New Spain'), NULL][doc_id * 5 % 4 + 1] AS c2, "
    "'a' || (doc_id % 17) AS u1, 'a' || (doc_id * 7 % 23) AS u2, source FROM documents)"
)


def low(c: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({c}, '')), '\\s+'), lambda t: t <> '')"


TOKENS = f"{PAPER_ROWS}, d AS (SELECT *, {low('title')} AS t, {low('abstract')} AS a FROM pp)"


def paper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    countries = F.array(*map(F.lit, COUNTRIES))

    def place(f, c, u):
        return F.struct(name("f", f).alias("id"), F.concat(F.lit("Institute "), f.cast("string")).alias("name"), F.get(countries, c.cast("int")).alias("country"), F.array(name("a", u)).alias("authors"))

    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        title.alias("title"),
        F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("abstract"),
        F.when(d % 11 > 0, 1990 + d % 30).alias("year"),
        F.concat(name("A", d % 17), F.lit("; "), name("a", d * 7 % 23), F.lit(" ;")).alias("author_ids"),
        F.array(place(d % 5, d % 4, d % 17), place(d * 3 % 7, d * 5 % 4, d * 7 % 23)).alias("affiliations"),
        "source",
    )


@query(
    f"WITH {TOKENS}, i AS (SELECT 'title' AS kind, unnest(list_distinct(t)) AS value, id FROM d UNION ALL SELECT 'abstract', unnest(list_distinct(a)), id FROM d UNION ALL SELECT 'year', year::VARCHAR, id FROM d WHERE year IS NOT NULL "
    "UNION ALL SELECT 'author', unnest(list_distinct([u1, u2])), id FROM d UNION ALL SELECT 'affiliation', unnest(list_distinct([f1, f2])), id FROM d UNION ALL SELECT 'country', unnest(list_distinct([lower(coalesce(c1, '')), lower(coalesce(c2, ''))])), id FROM d) "
    "SELECT kind, count(*) AS n_rows, count(DISTINCT value) AS n_values, max(value) AS last_value FROM i GROUP BY ALL"
)
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = S.build_index(paper_rows(spark, sf_dir)).groupBy("kind", "value").agg(F.count("*").alias("n"))
    return values.groupBy("kind").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_values"), F.max("value").alias("last_value"))


@query(
    f"WITH {TOKENS} SELECT id FROM d WHERE ((list_has_all(t, ['the']) AND list_contains(t, 'and') AND NOT list_contains(t, 'of') OR list_has_all(a, ['the'])) AND list_contains(a, 'and') AND NOT list_contains(a, 'of')) "
    "OR (list_has_all(t, ['die', 'und']) OR list_has_all(a, ['die', 'und']))"
)
def search_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(paper_rows(spark, sf_dir), [{"The": ["+and", "of"]}, "die und"]).select("id")


@query(f"WITH {TOKENS} SELECT id FROM d WHERE (list_contains(t, 'the') OR list_contains(a, 'the')) AND (list_contains(t, 'that') OR list_contains(a, 'that')) AND year IN (1995, 2003, 2010) AND (lower(coalesce(c1, '')) IN ('spain', '') OR lower(coalesce(c2, '')) IN ('spain', ''))")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(paper_rows(spark, sf_dir), ["the", "that"], {"year": [1995, 2003, 2010], "country": ["Spain", ""]}, match_all=True).select("id")


LINKED = "q1 AS (SELECT *, list_contains(t, 'of') OR list_contains(a, 'of') AS r1, (list_contains(t, 'of') AND NOT list_contains(t, 'that') OR list_contains(a, 'of')) AND NOT list_contains(a, 'that') AS o1, list_contains(t, 'license.') OR list_contains(a, 'license.') AS o2 FROM d)"


@query(f"WITH {TOKENS}, {LINKED} SELECT id FROM q1 WHERE (o1 OR (r1 AND o2)) AND o2")
def search_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(paper_rows(spark, sf_dir), [{"of": "that"}, "license."], match_all=True, linked=True).select("id")


def _window(c: str, test: str) -> str:
    """Some window of 12 tokens has the three words, by the positions of their first places in it."""
    at = lambda w: f"coalesce(list_position({c}[i:i + 11], '{w}'), 0)"
    return f"(CASE WHEN list_has_all({c}, ['of', 'that', 'the']) THEN len(list_filter(range(1, greatest(len({c}) - 10, 2)), lambda i: {test.format(of=at('of'), that=at('that'), the=at('the'))})) > 0 ELSE false END)"


@query(f"WITH {TOKENS}, h AS (SELECT id, {_window('t', '{of} > 0 AND {of} < {that} AND {that} < {the}')} OR {_window('a', '{of} > 0 AND {of} < {that} AND {that} < {the}')} AS in_order, {_window('t', '{of} > 0 AND {that} > 0 AND {the} > 0')} OR {_window('a', '{of} > 0 AND {that} > 0 AND {the} > 0')} AS together FROM d) SELECT * FROM h WHERE together")
def search_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.read_queries("of that the")[0]
    rows = paper_rows(spark, sf_dir).select("id", S.query_hit(q, 12).alias("in_order"), S.query_hit(q, 12, ordered=False).alias("together"))
    return rows.where("together")


@query(
    f"WITH {TOKENS}, h AS (SELECT 'query' AS filter_type, 'the +and -of' AS filter_value, id, (list_contains(t, 'the') AND list_contains(t, 'and') AND NOT list_contains(t, 'of') OR list_contains(a, 'the')) AND list_contains(a, 'and') AND NOT list_contains(a, 'of') AS hit FROM d UNION ALL SELECT 'query', 'nothing here', id, list_has_all(t, ['nothing', 'here']) OR list_has_all(a, ['nothing', 'here']) FROM d "
    "UNION ALL SELECT 'year', '2003', id, coalesce(year = 2003, false) FROM d UNION ALL SELECT 'author', 'A3', id, u1 = 'a3' OR u2 = 'a3' FROM d) SELECT filter_type, filter_value, count(*) FILTER (hit) AS num_papers, min(id) FILTER (hit) AS first_id, max(id) FILTER (hit) AS last_id FROM h GROUP BY ALL"
)
def search_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.explain(paper_rows(spark, sf_dir), [{"the": ["+and", "of"]}, "nothing here"], {"year": [2003], "author": ["A3"]})


@query(f"WITH {TOKENS} SELECT * FROM (SELECT id, CASE WHEN year >= 2015 AND list_contains(a, 'la') THEN 'recent' WHEN list_contains(a, 'und') THEN 'german' WHEN list_contains(a, 'the') THEN 'english' END AS search FROM d) WHERE search IS NOT NULL")
def search_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda w: S.has_words(S.lower_tokens(F.col("abstract")), [w])
    return S.filter_by_searches(paper_rows(spark, sf_dir), {"english": one("the"), "german": one("und"), "recent": (F.col("year") >= 2015) & one("la")}).select("id", "search")


RULES = {"apache license": {"positives": ["version", "license version"]}, "public license": {"positives": ["general public"], "negatives": ["mit"]}, "rights reserved": {}}


@query(
    "WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') || ' ' AS t FROM documents WHERE regexp_matches(text, '(?i)license|rights')), "
    "r AS (SELECT *, CASE WHEN contains(t, ' apache license ') AND contains(t, ' version ') AND contains(t, ' license version ') THEN 'apache license' WHEN contains(t, ' public license ') AND contains(t, ' general public ') AND NOT contains(t, ' mit ') THEN 'public license' WHEN contains(t, ' rights reserved ') THEN 'rights reserved' END AS rule FROM d) "
    "SELECT doc_id, coalesce(rule, '') AS rule, rule IS NOT NULL AND NOT contains(t, ' nc ') AS passed, CASE WHEN rule = 'apache license' THEN 'version|license version' WHEN rule = 'public license' THEN 'general public' ELSE '' END AS matched_positives FROM r"
)
def search_rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)license|rights"))
    out = S.rule_report(docs, RULES, negatives=["nc"], match_all=True)
    return out.select("doc_id", F.coalesce("rule", F.lit("")).alias("rule"), "passed", "matched_positives")


@query(f"WITH {PAPER_ROWS} SELECT id, true AS two_authors, u1 IN ('a3', 'a11') OR u2 IN ('a3', 'a11') AS has_author, (contains(lower(coalesce(c1, '')), 'spain') AND f1 IN ('f1', 'f2')) OR (contains(lower(coalesce(c2, '')), 'spain') AND f2 IN ('f1', 'f2')) AS at_spain, coalesce(year IN (1995, 2003), false) AND source IN (SELECT min(source) FROM pp) AS member FROM pp")
def field_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paper_rows(spark, sf_dir)
    least = rows.agg(F.min("source")).first()[0]
    member = F.coalesce(S.members({"year": [1995, 2003], "source": [least]}), F.lit(False))
    return rows.select("id", S.count_between("author_ids", 2, 2).alias("two_authors"), S.has_id("author_ids", ["a3", "A11"]).alias("has_author"), S.at_affiliation("spain", ["f1", "f2"]).alias("at_spain"), member.alias("member"))


WHOLE = "(^|[^\\pL\\pN_])"


@query(f"WITH {PAPER_ROWS} SELECT id FROM pp WHERE (coalesce(year <= 2000, false) OR coalesce(year >= 2012, false)) AND NOT coalesce(regexp_matches(abstract, '(?i)(^|[^\\pL\\pN_])and([^\\pL\\pN_]|$)'), false) OR (coalesce(regexp_matches(title, '(?i)(^|[^\\pL\\pN_])the([^\\pL\\pN_]|$)'), false) AND year = 2005)")
def nested_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = {"old": S.year_test("-2000"), "new": S.year_test("2012-"), "that_year": S.year_test("2005"), "and": S.keyword("and", ["abstract"]), "the": S.keyword("the", ["title"])}
    leaves = {k: F.coalesce(v, F.lit(False)) for k, v in leaves.items()}
    tree = ("or", ("and", ("or", "old", "new"), ("not", "and")), ("and", "the", "that_year"))
    return paper_rows(spark, sf_dir).where(S.combined(tree, leaves)).select("id")


@query(f"WITH {PAPER_ROWS}, w AS (SELECT u1 AS u FROM pp WHERE c1 = 'Spain' AND f1 = 'f4' AND year = 2014 UNION SELECT u2 FROM pp WHERE c2 = 'Spain' AND f2 = 'f4' AND year = 2014) SELECT id FROM pp WHERE u1 IN (SELECT u FROM w) OR u2 IN (SELECT u FROM w)")
def affiliation_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = lambda a: (a["country"] == "Spain") & (a["id"] == "f4")
    hit = S.year_test("2014") & F.coalesce(F.exists("affiliations", here), F.lit(False))
    return S.with_authors_of(paper_rows(spark, sf_dir), hit, here).select("id")


@query(f"WITH {PAPER_ROWS} SELECT id, (regexp_matches(title, '(?is)th.t') AND regexp_matches(title, '(?is)ing')) OR (regexp_matches(abstract, '(?is)th.t') AND regexp_matches(abstract, '(?is)licen[cs]e')) AS found, id IN (3, 5, 8) OR lower(source) = (SELECT lower(min(source)) FROM pp) AS wanted FROM pp")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paper_rows(spark, sf_dir).withColumn("doi", F.col("source"))
    least = rows.agg(F.min("source")).first()[0]
    found = S.text_search({"title": ["th.t", "ing"], "abstract": ["th.t", "licen[cs]e"]}, match_all=True)
    return rows.select("id", found.alias("found"), S.id_search(["id:3", "id:5", "id:8", f"doi:{least.upper()}"]).alias("wanted"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {REFERENCES} SELECT DISTINCT cited AS id FROM refs WHERE paper IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND cited IN (SELECT o_orderkey FROM orders)")
def citation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return S.cited_by(orders, references(spark, sf_dir), orders.where("o_orderstatus = 'P'")).select("id")


@query(f"WITH {PAPERS}, w AS (SELECT DISTINCT author FROM papers WHERE paper % 500 = 3) SELECT paper, count(DISTINCT author) AS shared FROM papers WHERE author IN (SELECT author FROM w) GROUP BY ALL")
def author_co_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = papers(spark, sf_dir)
    return S.sharing_authors(own, own.where("paper % 500 = 3").select("paper").distinct())


@query("WITH t AS (SELECT doc_id, [lang, source] AS tags FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_append(tags, 'seen'), lambda x: x <> 'de'), lambda x: CASE WHEN x = 'en' THEN 'english' ELSE x END))), ',') AS tags FROM t WHERE list_contains(tags, 'en') OR list_contains(tags, 'de')")
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    rows = rows.where(F.array_contains("tags", "en") | F.array_contains("tags", "de"))
    changed = S.replace_tag(S.remove_tag(S.add_tag(F.col("tags"), "seen"), "de"), "en", "english")
    return rows.select("doc_id", F.array_join(F.array_sort(F.array_distinct(changed)), ",").alias("tags"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 7 = 0) GROUP BY ALL")
def bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines pass the filter before they meet the orders it was made of."""
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = S.may_be_in(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", S.bloom(wanted, "l_orderkey", 1 << 16), 1 << 16)
    return lines.where("maybe").join(wanted, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_folder(spark)
    S.save_index(S.build_index(paper_rows(spark, sf_dir)), folder)
    return S.saved_index(spark, folder)


@query(f"WITH {TOKENS} SELECT id FROM d WHERE (list_contains(t, 'the') OR list_contains(a, 'the')) AND (list_contains(t, 'that') OR list_contains(a, 'that')) AND year IN (1995, 2003, 2010) AND (lower(coalesce(c1, '')) IN ('spain', '') OR lower(coalesce(c2, '')) IN ('spain', ''))")
def saved_index_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers of search_filters, from a saved index."""
    return S.look_up(_saved(spark, sf_dir), ["the", "that"], {"year": [1995, 2003, 2010], "country": ["Spain", ""]}, match_all=True)


@query(
    f"WITH {TOKENS} SELECT id FROM d WHERE ((list_has_all(t, ['the']) AND list_contains(t, 'and') AND NOT list_contains(t, 'of') OR list_has_all(a, ['the'])) AND list_contains(a, 'and') AND NOT list_contains(a, 'of')) "
    "OR (list_has_all(t, ['die', 'und']) OR list_has_all(a, ['die', 'und']))"
)
def saved_index_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers of search_dependents, from a saved index."""
    papers = paper_rows(spark, sf_dir)
    return S.search_saved(_saved(spark, sf_dir), papers, [{"The": ["+and", "of"]}, "die und"]).select("id")
