"""Queries on the given tables, by name, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..graph import paths
from ..graph.components import connected_components
from ..graph.ranks import degrees, hits, pagerank
from ..operators import entities, factor, hierarchy, reports, stats, tensor, text, triplets, vectors
from ..shared import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Fixed values used by queries and their SQL.
STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "for", "it", "as", "with", "was", "on", "be", "by", "this"]
TERMS = ["the", "and", "und", "la", "que", "license"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers, their suppliers as authors."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("author"))
    return lines.join(orders, "paper")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order o cites (7 o + 1) mod n and (11 o + 3) mod n of n orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"))
    n = orders.count()
    cited = F.array((F.col("paper") * 7 + 1) % n, (F.col("paper") * 11 + 3) % n)
    return orders.select("paper", F.explode(F.array_distinct(cited)).alias("cited"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to part groups, weighted by quantity."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97 + 1).alias("dst")).agg(F.sum(F.col("l_quantity").cast("double")).alias("weight"))


LOW = "list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')"
POSTINGS = f"p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({LOW}) AS token FROM documents) GROUP BY ALL)"
PAPERS = "papers AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS author, year(o_orderdate) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
REFERENCES = "n AS (SELECT count(*) AS n FROM orders), refs AS (SELECT DISTINCT o_orderkey AS paper, unnest([(o_orderkey * 7 + 1) % n, (o_orderkey * 11 + 3) % n]) AS cited FROM orders, n)"
EDGES = "e AS (SELECT l_suppkey AS src, l_partkey % 97 + 1 AS dst, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY ALL)"
NODES = "nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
quoted = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"WITH {POSTINGS}, w AS (SELECT token AS word, sum(tf) AS tf, count(*) AS df FROM p GROUP BY ALL) SELECT word, tf::BIGINT AS tf, df, df / (SELECT count(*) FROM documents) AS df_fraction, tf / (SELECT count(*) FROM w) AS tf_fraction FROM w ORDER BY tf DESC, word LIMIT 100")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top_words(table(spark, sf_dir, "documents"), 100)


@query(
    f"WITH d AS (SELECT doc_id, {LOW} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS word FROM d), p AS (SELECT doc_id, word, count(*) AS n FROM g GROUP BY ALL), w AS (SELECT word, sum(n)::BIGINT AS tf, count(*) AS df FROM p GROUP BY ALL) SELECT word, tf, df, df / (SELECT count(*) FROM documents) AS df_fraction, tf / (SELECT count(*) FROM w) AS tf_fraction FROM w ORDER BY tf DESC, word LIMIT 100"
)
def top_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top_words(table(spark, sf_dir, "documents"), 100, n_gram=2)


@query(f"WITH {POSTINGS} SELECT token, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM p GROUP BY ALL")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.inverted_index(table(spark, sf_dir, "documents"))


@query(
    "WITH a AS (SELECT doc_id, lower(translate(coalesce(text, ''), '‐‑‒–—―−⸺⸻', '---------')) AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\S*@\\S*\\s?', '', 'g'), '\\[.*?\\]', ' ', 'g'), '\\(.*?\\)', ' ', 'g') AS t FROM a), "
    "c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[!|\"#$%&''()*+,./:;<=>?@\\[\\]^_`{}~]', '', 'g'), '[^\\x00-\\x7F]+', '', 'g') AS t FROM b) "
    f"SELECT doc_id, nullif(trim(array_to_string(list_filter(string_split_regex(t, '\\s+'), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({quoted(STOP_WORDS)})), ' ')), '') AS cleaned FROM c"
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("remove_email", "remove_between_[]", "remove_between_()", "remove_special_characters", "remove_nonASCII")
    steps = [T.standardize_hyphens, F.lower, *map(T.pattern_step, names), T.drop_tokens(STOP_WORDS, 2, numbers=False)]
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text"), steps).alias("cleaned"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, coalesce(sum((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}), 0)::BIGINT AS tf, count(*) FILTER (contains(lower(text), '{t}')) AS df FROM documents" for t in TERMS))
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_counts(table(spark, sf_dir, "documents"), TERMS)


@query(f"WITH {POSTINGS} SELECT token AS term, doc_id, tf FROM p WHERE token IN ({quoted(TERMS)})")
def term_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_attribution(table(spark, sf_dir, "documents"), TERMS)


@query(f"SELECT doc_id, array_to_string(list_filter([{quoted(TERMS)}], lambda t: contains(lower(coalesce(text, '')), t)), ', ') AS terms FROM documents")
def term_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_columns(table(spark, sf_dir, "documents"), TERMS)


@query(
    f"WITH d AS (SELECT doc_id, {LOW} AS w, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS s FROM documents), r AS (SELECT doc_id, length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(s), 1) AS ascii_share, len(list_filter(w, lambda t: t IN ({quoted(STOP_WORDS)}))) / greatest(len(w), 1) AS stop_share FROM d) SELECT *, ascii_share >= 0.9 AND stop_share >= 0.2 AS english FROM r"
)
def english_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.english_only(table(spark, sf_dir, "documents"), STOP_WORDS)


@query(f"WITH d AS (SELECT doc_id, {LOW} AS w FROM documents) SELECT doc_id FROM d WHERE (list_has_all(w, ['shall', 'the']) OR list_has_all(w, ['license.', 'the']) OR list_has_all(w, ['la', 'un'])) AND list_contains(w, 'de') AND NOT list_contains(w, 'avec')")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return text.search(docs, [["shall", "the"], ["license.", "the"], ["la", "un"]], ["de"], ["avec"]).select("doc_id")


@query(f"WITH d AS (SELECT doc_id, {LOW} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d) SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.t = 'of' AND b.t = 'that' AND b.i > a.i AND b.i - a.i < 8")
def search_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.ordered_window(table(spark, sf_dir, "documents"), ["of", "that"], 8)


RULES = {"apache license": {"positives": ["version"]}, "public license": {"positives": ["gnu", "version"], "negatives": ["mit"]}, "rights reserved": {}}


@query(
    "WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') || ' ' AS t FROM documents WHERE regexp_matches(text, '(?i)license|rights')) "
    "SELECT * FROM (SELECT doc_id, CASE WHEN contains(t, ' apache license ') AND contains(t, ' version ') THEN 'apache license' WHEN contains(t, ' public license ') AND NOT contains(t, ' mit ') AND (contains(t, ' gnu ') OR contains(t, ' version ')) THEN 'public license' WHEN contains(t, ' rights reserved ') THEN 'rights reserved' END AS rule FROM d) WHERE rule IS NOT NULL"
)
def search_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)license|rights"))  # any rule's main phrase has one of these
    return text.rule_matches(docs, RULES)


@query(f"WITH {POSTINGS}, w AS (SELECT token, count(*) AS df, sum(tf) AS tf FROM p GROUP BY ALL HAVING count(*) >= 40 AND regexp_matches(token, '^[a-z]{{2,}}$')) SELECT a.token AS a, b.token AS b, CASE WHEN a.tf > b.tf THEN a.token ELSE b.token END AS kept FROM w a JOIN w b ON a.token < b.token AND a.token[1] = b.token[1] AND levenshtein(a.token, b.token) <= 1")
def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.near_words(table(spark, sf_dir, "documents"), 40)


@query(
    f"WITH {POSTINGS}, n AS (SELECT count(*) AS n FROM documents), w AS (SELECT token, count(*) AS df FROM p GROUP BY ALL HAVING count(*) >= 5 AND count(*) <= 0.9 * (SELECT n FROM n)), r AS (SELECT doc_id, token, tf, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM p JOIN w USING (token), n) SELECT doc_id, token, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r"
)
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.tf_idf(table(spark, sf_dir, "documents"), 5, 0.9).withColumn("weight", F.round("weight", 6))


COOC = (
    f"{POSTINGS}, v AS (SELECT token FROM p GROUP BY ALL HAVING count(*) >= 5 ORDER BY sum(tf) DESC, token LIMIT 200), t AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {LOW} AS w FROM documents)), k AS (SELECT t.* FROM t JOIN v USING (token)), "
    "h AS (SELECT x.token AS a, y.token AS b FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.i > x.i AND y.i <= x.i + 5), c AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM h UNION ALL SELECT b, a FROM h) GROUP BY ALL)"
)


def counted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tensor.co_occurrence(docs, tensor.vocabulary(docs, 5, max_features=200), 5)


@query(f"WITH {COOC} SELECT * FROM c")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_pairs(spark, sf_dir)


@query(f"WITH {COOC}, s AS (SELECT a, sum(n) AS r FROM c GROUP BY ALL) SELECT c.a, c.b, round(ln(n::DOUBLE * (SELECT sum(n) FROM c)::DOUBLE / (x.r::DOUBLE * y.r::DOUBLE)) - 0.1, 6) AS value FROM c JOIN s x ON c.a = x.a JOIN s y ON c.b = y.a WHERE ln(n::DOUBLE * (SELECT sum(n) FROM c)::DOUBLE / (x.r::DOUBLE * y.r::DOUBLE)) - 0.1 > 0")
def sppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.sppmi(counted_pairs(spark, sf_dir), 0.1).withColumn("value", F.round("value", 6))


@query(f"WITH {PAPERS} SELECT x.author AS a, y.author AS b, x.year, count(*) AS n FROM papers x JOIN papers y ON x.paper = y.paper AND x.author <> y.author GROUP BY ALL")
def co_author_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.co_authors(papers(spark, sf_dir))


@query(f"WITH {PAPERS} SELECT author, paper, year, 1 AS value FROM papers")
def participation_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.participation(papers(spark, sf_dir))


@query(f"WITH {PAPERS}, {REFERENCES} SELECT author, cited, year, count(*) AS n FROM papers JOIN refs USING (paper) WHERE cited IN (SELECT paper FROM papers) GROUP BY ALL")
def citation_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.citations(papers(spark, sf_dir), references(spark, sf_dir))


@query(f"WITH {PAPERS}, {REFERENCES}, s AS (SELECT paper, 1.0 / count(*) AS share FROM papers GROUP BY ALL) SELECT x.author, y.author AS cited_author, x.year, round(sum(share::DOUBLE), 6) AS weight FROM papers x JOIN refs USING (paper) JOIN papers y ON y.paper = cited JOIN s ON s.paper = cited GROUP BY ALL")
def co_citation_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.co_citations(papers(spark, sf_dir), references(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"SELECT conv_id, word, turn, count(*) AS n FROM (SELECT conv_id, turn, unnest({LOW}) AS word FROM conversations) GROUP BY ALL")
def entity_word_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.entity_word_time(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query('SELECT c_nationkey AS "row", (o_custkey % 7) * 10 + year(o_orderdate) % 10 AS col, count(*) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL')
def unfold_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cells = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("i"), (F.col("o_custkey") % 7).alias("j"), (F.year("o_orderdate") % 10).alias("t")).agg(F.count("*").alias("v"))
    there = tensor.unfold(cells, "i", ("j", "t"), 10)
    return tensor.unfold(tensor.fold(there, "i", ("j", "t"), 10), "i", ("j", "t"), 10)


CITED = "cited AS (SELECT cited AS paper, count(*) AS citations FROM refs GROUP BY ALL), pc AS (SELECT papers.*, coalesce(citations, 0) AS citations FROM papers LEFT JOIN cited USING (paper)), s AS (SELECT paper, 1.0 / count(DISTINCT author) AS share FROM pc GROUP BY ALL)"


def cited_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = references(spark, sf_dir).groupBy(F.col("cited").alias("paper")).agg(F.count("*").alias("citations"))
    return papers(spark, sf_dir).join(counts, "paper", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))


@query(f"WITH {PAPERS}, {REFERENCES}, {CITED} SELECT author, year, count(DISTINCT paper) AS paper_count, sum(citations)::BIGINT AS num_citations, round(avg(share::DOUBLE), 6) AS attribution FROM pc JOIN s USING (paper) GROUP BY ALL")
def originator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.originator_stats(cited_papers(spark, sf_dir)).withColumn("attribution", F.round("attribution", 6))


@query(
    f"WITH {PAPERS}, {REFERENCES}, {CITED}, y AS (SELECT author, year, count(DISTINCT paper) AS k, sum(citations) AS c, avg(share::DOUBLE) AS a FROM pc JOIN s USING (paper) GROUP BY ALL) SELECT author, sum(k)::BIGINT AS paper_count, sum(c)::BIGINT AS num_citations, round(sum(a * k) / sum(k), 6) AS attribution FROM y GROUP BY ALL"
)
def originator_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.time_roll_up(stats.originator_stats(cited_papers(spark, sf_dir))).withColumn("attribution", F.round("attribution", 6))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL) SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1")
def mode_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mode_map(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_l_quantity, avg(l_extendedprice)::DOUBLE AS mean_l_extendedprice, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.group_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], ["l_extendedprice"], ["l_partkey", "l_suppkey"])
    return out.withColumn("sum_l_quantity", F.col("sum_l_quantity").cast("double")).withColumn("mean_l_extendedprice", F.col("mean_l_extendedprice").cast("double"))


@query("SELECT c_nationkey, c_custkey, place FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_per_group(table(spark, sf_dir, "customer"), "c_nationkey", [F.desc("c_acctbal"), "c_custkey"], 5).select("c_nationkey", "c_custkey", "place")


@query(
    "WITH c AS (SELECT sum((quality = 1 AND toxic = 1)::INT)::DOUBLE AS tp, sum((quality = 0 AND toxic = 1)::INT)::DOUBLE AS fp, sum((quality = 1 AND toxic = 0)::INT)::DOUBLE AS fn, sum((quality = 0 AND toxic = 0)::INT)::DOUBLE AS tn FROM labels) "
    "SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp / (tp + fp) * (tp + fn) + tn / (tn + fn) * (tn + fp)) / (tp + fp + fn + tn) AS precision, (tp + tn) / (tp + fp + fn + tn) AS recall, (2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / (tp + fp + fn + tn) AS f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM c"
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion_metrics(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("WITH s AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), b AS (SELECT n_chars, sum((quality = 1)::INT)::DOUBLE AS p, sum((quality = 0)::INT)::DOUBLE AS q FROM s GROUP BY ALL), c AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM c")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return reports.curve_areas(rows, "quality", "n_chars").select(F.col("roc_auc").alias("auc"))


@query("SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(c_name, s_name) AS name, coalesce(c_nationkey, s_nationkey) AS nation, c_mktsegment, s_acctbal::DOUBLE AS s_acctbal FROM (SELECT * FROM customer WHERE c_custkey % 3 > 0) FULL JOIN supplier ON c_custkey = s_suppkey")
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation", "c_mktsegment")
    right = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_nationkey AS nation", "CAST(s_acctbal AS DOUBLE) AS s_acctbal")
    return stats.merge_prefer_left(left, right, "key")


@query("WITH r AS (SELECT o_custkey % 500 AS key, o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS b FROM orders) SELECT key, id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (a IS NULL)::INT + (b IS NULL)::INT, id) AS n FROM r) WHERE n = 1")
def fewest_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey % 500 AS key", "o_orderkey AS id", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS a", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS b")
    return stats.drop_by_fewest_nulls(rows, "key", ["id"])


@query("WITH d AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) SELECT * FROM d WHERE o_custkey IN (SELECT o_custkey FROM d GROUP BY ALL HAVING count(*) = 1)")
def drop_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.drop_conflicts(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", ["o_orderstatus"])


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer UNION ALL SELECT -s_suppkey, s_name FROM supplier")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name")
    changes = store.where("key % 4 = 0").selectExpr("key", "upper(name) AS name").unionByName(table(spark, sf_dir, "supplier").selectExpr("-s_suppkey AS key", "s_name AS name"))
    return stats.upsert(store, changes, "key")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_different FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")))
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.uniqueness(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])


@query(
    f"WITH {REFERENCES}, h0 AS (SELECT o_orderkey AS paper, 0 AS hop FROM orders WHERE o_orderstatus = 'P'), h1 AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT cited, 1 FROM refs JOIN h0 USING (paper) WHERE cited NOT IN (SELECT paper FROM h0)), h2 AS (SELECT * FROM h1 UNION ALL SELECT DISTINCT cited, 2 FROM refs JOIN h1 USING (paper) WHERE hop = 1 AND cited NOT IN (SELECT paper FROM h1)) SELECT * FROM h2"
)
def citation_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("paper"))
    return stats.citation_hops(references(spark, sf_dir), seeds, 2)


@query("WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) SELECT label, i - 1 AS i, round(x, 5) AS x FROM m")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.centroids(table(spark, sf_dir, "embeddings"), "label")
    return out.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


DISTANCES = "m AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT vec_id, v.label, sqrt(sum((x - c) * (x - c))) AS distance FROM v JOIN m ON v.label = m.label AND v.i = m.i GROUP BY ALL)"


@query(f"WITH {DISTANCES} SELECT label, vec_id, place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(distance, 7), vec_id) AS place FROM d) WHERE place <= 3")
def nearest_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = vectors.centroid_distances(table(spark, sf_dir, "embeddings"), "label")
    return stats.top_per_group(far, "label", [F.round("distance", 7), "vec_id"], 3).select("label", "vec_id", "place")


@query(
    "WITH m AS (SELECT i, avg(x) AS c FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 0) GROUP BY ALL), v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT vec_id, label, sqrt(sum((x - c) * (x - c))) AS distance FROM v JOIN m USING (i) GROUP BY ALL) SELECT vec_id, distance <= (SELECT avg(distance) + 3 * stddev_pop(distance) FROM d WHERE label = 0) AS kept FROM d"
)
def prune_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.prune_by_reference(table(spark, sf_dir, "embeddings"), F.col("label") == 0).select("vec_id", "kept")


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT query_id, id, list_cosine_similarity(q.e, r.e) AS similarity FROM q, r WHERE query_id <> id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS place FROM s) SELECT query_id, id, round(similarity, 6) AS similarity, place FROM t WHERE place <= 5"
)
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 20 = 0"), 5).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {EDGES}, {NODES}, o AS (SELECT src AS node, count(*) AS k, sum(weight) AS w FROM e GROUP BY ALL), i AS (SELECT dst AS node, count(*) AS k, sum(weight) AS w FROM e GROUP BY ALL) SELECT node, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree, coalesce(i.w, 0) AS in_weight, coalesce(o.w, 0) AS out_weight FROM nodes LEFT JOIN o USING (node) LEFT JOIN i USING (node)")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(edges(spark, sf_dir))


def rank_rounds(n: int) -> str:
    out = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for k in range(1, n + 1):
        out.append(
            f"g{k} AS (SELECT dst AS node, sum(r * weight / w) AS g FROM e JOIN o USING (src) JOIN r{k - 1} ON node = src GROUP BY ALL), r{k} AS (SELECT node, 0.85 * (coalesce(g, 0) + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM nodes)) + 0.15 / (SELECT count(*) FROM nodes) AS r FROM nodes LEFT JOIN g{k} USING (node))"
        )
    return ", ".join(out)


@query(f"WITH {EDGES}, {NODES}, o AS (SELECT src, sum(weight) AS w FROM e GROUP BY ALL), {rank_rounds(10)} SELECT node, round(r, 9) AS rank FROM r10")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(edges(spark, sf_dir), rounds=10, tolerance=0).withColumn("rank", F.round("rank", 9))


def hits_rounds(n: int) -> str:
    out = ["h0 AS (SELECT node, 1.0::DOUBLE AS h FROM nodes)"]
    for k in range(1, n + 1):
        out.append(f"b{k} AS (SELECT dst AS node, sum(h * weight) AS a FROM e JOIN h{k - 1} ON node = src GROUP BY ALL), a{k} AS (SELECT node, a / (SELECT sum(a) FROM b{k}) AS a FROM b{k}), c{k} AS (SELECT src AS node, sum(a * weight) AS h FROM e JOIN a{k} ON node = dst GROUP BY ALL), h{k} AS (SELECT node, h / (SELECT sum(h) FROM c{k}) AS h FROM c{k})")
    return ", ".join(out)


@query(f"WITH {EDGES}, {NODES}, {hits_rounds(6)} SELECT node, round(coalesce(h, 0), 9) AS hub, round(coalesce(a, 0), 9) AS authority FROM nodes LEFT JOIN h6 USING (node) LEFT JOIN a6 USING (node)")
def graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(edges(spark, sf_dir), 6).select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


@query(
    "WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey - o_orderkey % 13 AS b FROM orders WHERE o_orderkey % 13 > 0 UNION SELECT o_orderkey, o_orderkey + 13 FROM orders WHERE o_orderkey % 169 = 0), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT DISTINCT a AS node, a AS seen FROM f UNION SELECT w.node, f.b FROM w JOIN f ON f.a = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY ALL"
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    near = orders.where("o_orderkey % 13 > 0").selectExpr("o_orderkey AS src", "o_orderkey - o_orderkey % 13 AS dst")
    far = orders.where("o_orderkey % 169 = 0").selectExpr("o_orderkey AS src", "o_orderkey + 13 AS dst")
    return connected_components(near.unionByName(far))


@query("PIVOT (SELECT user_id, event_type, value FROM events) ON event_type IN ('click', 'view', 'purchase') USING sum(value) GROUP BY user_id")
def pivot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.sum("value"))


@query()
def nmf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the document-word matrix: the ten heaviest words of each."""
    cells = tensor.tf_idf(table(spark, sf_dir, "documents"), 20, 0.5).selectExpr("doc_id AS i", "token AS j", "weight AS v")
    _, h, _ = factor.distributed_nmf(cells, rank=4, rounds=5)
    words = h.select(F.col("j").alias("word"), F.posexplode("h").alias("topic", "weight"))
    return stats.top_per_group(words, "topic", [F.desc("weight"), "word"], 10)


@query()
def rank_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability of factorizations of the segment-by-nation order matrix for ranks 2 to 5."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cells = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("i"), F.expr("5 * (month(o_orderdate) - 1) + ascii(c_mktsegment) % 5").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return factor.select_rank(cells, ranks=[2, 3, 4, 5], perturbations=6, rounds=100)


NATIONS = (
    "nat AS (SELECT c_nationkey AS i, s_nationkey AS j, count(*) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), "
    "e AS (SELECT i AS src, j AS dst, v AS weight FROM nat WHERE v >= 1.3::DOUBLE * (SELECT sum(v)::DOUBLE / count(*) FROM nat)), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), one AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)"
)
REACH = "walk AS (SELECT node AS source, node, 0 AS d FROM nodes UNION SELECT source, dst, d + 1 FROM walk JOIN one ON src = node WHERE d < 24), dist AS (SELECT source, node, min(d) AS d FROM walk GROUP BY ALL)"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nations to supplier nations, where lines are 1.3 times the mean or more."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers, suppliers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("c_custkey") == F.col("o_custkey")).join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    cells = checkpointed(joined.groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.count("*").alias("v")))
    total, n = cells.agg(F.sum("v"), F.count("*")).first()
    return paths.strong_edges(cells, 1.3 * (total / n))


@query(f"WITH RECURSIVE {NATIONS}, {REACH}, s AS (SELECT node, count(*) AS r, sum(d) AS t FROM dist WHERE d > 0 GROUP BY ALL) SELECT node, round(coalesce(r / t * r / ((SELECT count(*) FROM nodes) - 1), 0), 9) AS closeness FROM nodes LEFT JOIN s USING (node)")
def graph_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.closeness(trade(spark, sf_dir)).withColumn("closeness", F.round("closeness", 9))


@query(
    f"WITH RECURSIVE {NATIONS}, {REACH}, k0 AS (SELECT node AS source, node, 1.0::DOUBLE AS c FROM nodes), " + ", ".join(f"k{i} AS (SELECT source, dst AS node, sum(c) AS c FROM k{i - 1} JOIN one ON src = node GROUP BY ALL)" for i in range(1, 13)) + ", "
    "k AS (" + " UNION ALL ".join(f"SELECT source, node, c, {i} AS d FROM k{i}" for i in range(13)) + "), p AS (SELECT source, node, d, c FROM dist JOIN k USING (source, node, d)), "
    "b AS (SELECT x.node, sum(x.c * y.c / z.c) AS b FROM p x JOIN p y ON y.source = x.node JOIN p z ON z.source = x.source AND z.node = y.node AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY ALL) "
    "SELECT node, round(coalesce(b, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 9) AS betweenness FROM nodes LEFT JOIN b USING (node)"
)
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.betweenness(trade(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 9))


@query(f"WITH RECURSIVE {NATIONS}, r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT a, dst FROM r JOIN one ON src = b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY ALL")
def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.strong_components(trade(spark, sf_dir))


@query(f"WITH {NATIONS}, c AS (SELECT 1 AS node), inside AS (SELECT node FROM c UNION SELECT dst FROM e JOIN c ON src = node) SELECT src, dst, weight FROM e WHERE src IN (FROM inside) AND dst IN (FROM inside)")
def graph_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade(spark, sf_dir)
    return paths.ego(edges, edges.select(F.lit(1).cast("long").alias("node")).distinct())


ACRONYM_SQL = " UNION ".join(
    f"SELECT doc_id, {word} AS acronym, {' || chr(32) || '.join(f'l{k}' for k in run)} AS expansion FROM l WHERE l{n} IS NOT NULL AND {word} = {' || '.join(f'l{k}[1]' for k in run)}"
    for n in range(2, 8)
    for word, run in (("l0", range(1, n + 1)), (f"l{n}", range(n)))
)


@query(f"WITH t AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {LOW} AS w FROM documents)), l AS (SELECT doc_id, token AS l0, {', '.join(f'lead(token, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS l{k}' for k in range(1, 8))} FROM t) {ACRONYM_SQL}")
def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.lower_tokens(F.col("text")).alias("words"))  # a column, so that each text is split once
    return words.select("doc_id", F.inline(W.acronyms(F.col("words"))))


#: Fixed values used by the query and its SQL: terms with what stands in their place.
SUBSTITUTIONS = {"apache license": "apache_license", "public license": "public_license", "the": "_the_", "of": "of"}


@query(
    "WITH d AS (SELECT doc_id, '  ' || regexp_replace(text, '(\\s)', '\\1\\1', 'g') || '  ' AS t FROM documents), r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(\\s)apache  license(\\s)', '\\1apache_license\\2', 'g'), '(\\s)public  license(\\s)', '\\1public_license\\2', 'g'), '(\\s)the(\\s)', '\\1_the_\\2', 'g') AS t FROM d), "
    "c AS (SELECT doc_id, regexp_replace(t, '(\\s)\\s', '\\1', 'g') AS t FROM r) SELECT doc_id, md5(t[2:-2]) AS digest FROM c"
)
def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(W.substitute(SUBSTITUTIONS)(F.col("text"))).alias("digest"))


STEM_SQL = "CASE " + " ".join(f"WHEN ends_with(token, '{e}') AND length(token) >= {len(e) + 3} THEN token[:length(token) - {len(e)}] || '{n}'" for e, n in W.ENDINGS) + " ELSE token END"


@query(f"WITH {POSTINGS}, w AS (SELECT token, sum(tf) AS tf FROM p WHERE regexp_matches(token, '^[a-z]+$') GROUP BY ALL), s AS (SELECT *, {STEM_SQL} AS stem FROM w) SELECT stem, count(*) AS n_words, sum(tf)::BIGINT AS tf, arg_min(token, (length(token), token)) AS shortest FROM s GROUP BY ALL")
def stem_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.postings(table(spark, sf_dir, "documents")).where(F.col("token").rlike("^[a-z]+$")).groupBy("token").agg(F.sum("tf").alias("tf"))
    return words.groupBy(W.stem(F.col("token")).alias("stem")).agg(F.count("*").alias("n_words"), F.sum("tf").alias("tf"), F.min_by("token", F.struct(F.length("token"), F.col("token"))).alias("shortest"))


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper, id, name: suppliers as authors of orders."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("id")).distinct().join(suppliers, "id").select("paper", "id", "name")


KEY = "array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')), ' ')"


@query("SELECT DISTINCT l_suppkey::VARCHAR AS id, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = authorships(spark, sf_dir).groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("x"))
    joined = lists.select("paper", F.array_join(F.col("x.id").cast("array<string>"), ";").alias("author_ids"), F.array_join("x.name", "; ").alias("authors"))
    return entities.id_names(joined)


@query(
    f"WITH a AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS id, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), l AS (SELECT paper, id AS left_id, {KEY.format('name')} AS x FROM a), r AS (SELECT paper, id + 100000 AS right_id, {KEY.format("substr(name, 10) || ', SUPPLIER'")} AS y FROM a WHERE paper % 3 > 0), "
    "c AS (SELECT left_id, right_id, count(DISTINCT paper) AS papers, max(1 - levenshtein(x, y) / greatest(length(x), length(y))) AS similarity FROM l JOIN r USING (paper) WHERE 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.8 GROUP BY ALL) "
    "SELECT left_id, right_id, papers, similarity FROM c QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY papers DESC, similarity DESC, right_id) = 1"
)
def author_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = authorships(spark, sf_dir)
    right = left.where("paper % 3 > 0").selectExpr("paper", "id + 100000 AS id", "substr(name, 10) || ', SUPPLIER' AS name")
    return entities.match_authors(left, right)


@query(
    "WITH a AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS id, p_name AS k FROM lineitem JOIN part ON p_partkey = l_partkey), o AS (SELECT DISTINCT x.id, x.k, y.id AS other FROM a x JOIN a y ON x.paper = y.paper AND x.id <> y.id), "
    "s AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM o x JOIN o y ON x.k = y.k AND x.other = y.other AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, shared FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = s.a AND o.other = s.b)"
)
def author_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("id")).join(parts, "id")
    return entities.possible_duplicates(rows)


@query(
    "WITH RECURSIVE p AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 7 AND y.c_mktsegment = x.c_mktsegment), f AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w AS (SELECT c_custkey AS id, c_custkey AS seen FROM customer UNION SELECT id, b FROM w JOIN f ON a = seen), "
    "u AS (SELECT id, min(seen) AS unified FROM w GROUP BY ALL), n AS (SELECT unified, arg_min(c_name, (-length(c_name), c_name)) AS name FROM u JOIN customer ON c_custkey = id GROUP BY ALL) SELECT id, unified, name FROM u JOIN n USING (unified)"
)
def author_unified_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS s")
    pairs = customers.selectExpr("id AS a", "id + 7 AS b", "s").join(customers.selectExpr("id AS b", "s"), ["b", "s"])
    return entities.unified_ids(pairs, customers.select("id", "name"))


@query("SELECT l_suppkey AS id, c_nationkey AS affiliation, min(year(o_orderdate)) AS first_seen, max(year(o_orderdate)) AS last_seen, count(DISTINCT o_orderkey) AS papers FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def author_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), "o_custkey", F.year("o_orderdate").alias("year"))
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("affiliation"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("id"))
    return entities.affiliations(lines.join(orders, "paper").join(nations, "o_custkey"))


LABELS = "(c_custkey // (run + 1)) % 4"


@query(f"WITH l AS (SELECT run, c_custkey AS i, {LABELS} AS label FROM customer, range(5) r(run)), p AS (SELECT i, list(label ORDER BY run) AS v FROM l GROUP BY ALL), s AS (SELECT list_sum(list_transform(range(1, 6), lambda k: (x.v[k] = y.v[k])::INT)) / 5 AS together FROM p x JOIN p y ON x.i < y.i) SELECT round(together, 6) AS together, count(*) AS pairs FROM s GROUP BY ALL")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run"))
    return hierarchy.co_assignment(runs.select("run", "i", F.expr("(i div (run + 1)) % 4").alias("label"))).withColumn("together", F.round("together", 6))


@query()
def topic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the leaf of a two-level topic tree."""
    cells = tensor.tf_idf(table(spark, sf_dir, "documents"), 20, 0.5).selectExpr("doc_id AS i", "token AS j", "weight AS v")
    return hierarchy.topic_tree(cells, rank=3, depth=2, least=30, rounds=8).select(F.col("i").alias("doc_id"), "node")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, v: quantities that suppliers sold of part groups."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 97).alias("j")).agg(F.avg(F.col("l_quantity").cast("double")).alias("v"))


@query()
def rating_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and modelled quantities by supplier and part group."""
    cells = ratings(spark, sf_dir)
    return hierarchy.predict_ratings(cells, *hierarchy.recommender(cells, rank=3, rounds=6))


@query()
def logistic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biases of suppliers in a model of quantities above 25."""
    cells = ratings(spark, sf_dir).withColumn("v", (F.col("v") > 25).cast("int"))
    return hierarchy.logistic_factors(cells, rank=2, rounds=6)[0].select(F.col("i").alias("supplier"), F.col("bu").alias("bias"))


@query(
    "WITH t AS (SELECT o_orderkey::VARCHAR AS head, 'order' AS head_type, 'placed_by' AS relation, o_custkey::VARCHAR AS tail, 'customer' AS tail_type, o_totalprice::DOUBLE AS weight FROM orders "
    "UNION ALL SELECT o_custkey::VARCHAR, 'customer', 'asks_for', o_orderpriority, 'priority', 1 FROM orders "
    "UNION ALL SELECT o_orderkey::VARCHAR, 'order', 'made_in', year(o_orderdate)::VARCHAR, 'year', 1 FROM orders) "
    "SELECT head, head_type, relation, tail, tail_type, round(sum(weight), 2) AS weight FROM t GROUP BY ALL"
)
def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, priorities and years as triplets."""
    relations = [
        triplets.Relation("placed_by", "o_orderkey", "order", "o_custkey", "customer", weight="o_totalprice"),
        triplets.Relation("asks_for", "o_custkey", "customer", "o_orderpriority", "priority"),
        triplets.Relation("made_in", "o_orderkey", "order", "year(o_orderdate)", "year"),
    ]
    return triplets.edges_of(triplets.triplets(table(spark, sf_dir, "orders"), relations)).withColumn("weight", F.round("weight", 2))


@query("WITH n AS (SELECT DISTINCT c_custkey::VARCHAR AS id, 'customer' AS type, c_mktsegment AS segment FROM customer UNION SELECT DISTINCT c_nationkey::VARCHAR, 'nation', NULL FROM customer) SELECT * FROM n")
def knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph of customers and nations, with the segment that customers carry."""
    lives = triplets.Relation("lives_in", "c_custkey", "customer", "c_nationkey", "nation", head_attributes={"segment": "c_mktsegment"})
    nodes = triplets.nodes_of(triplets.triplets(table(spark, sf_dir, "customer"), [lives]))
    return nodes.select("id", "type", F.col("attributes")["segment"].alias("segment"))


@query()
def joint_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in topics common to the nations they deliver to and the part groups they deliver."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    nations = lines.join(orders, "l_orderkey").groupBy(F.col("l_suppkey").alias("i"), F.col("c_nationkey").alias("j")).agg(F.count("*").cast("double").alias("v"))
    groups = lines.groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 97).alias("j")).agg(F.count("*").cast("double").alias("v"))
    w, _ = factor.joint_nmf({"nations": nations, "groups": groups}, {"nations": 2, "groups": 2}, rank=2, rounds=4)
    return w.select(F.col("i").alias("supplier"), hierarchy.strongest(F.col("w")).alias("topic"))


from . import clean_queries, file_queries, matrix_queries, report_queries, search_queries  # noqa: E402,F401  (they register their queries)
