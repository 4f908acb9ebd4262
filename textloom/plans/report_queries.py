"""Queries of paper, author, funder and cluster tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import tensor
from ..shared import shuffles_dropped, written
from .queries import LOW, POSTINGS, REFERENCES, TERMS, query, quoted, references, table

LINES = (
    f"{REFERENCES}, cited AS (SELECT cited, count(*) AS c FROM refs GROUP BY ALL), "
    "lines AS (SELECT o_orderkey AS paper, s_suppkey AS author, n_name AS affiliation, r_name AS country, year(o_orderdate) AS year, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS type, o_custkey % 8 AS cluster, o_custkey AS customer, coalesce(c, 0) AS citations "
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN cited ON cited.cited = o_orderkey)"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers, suppliers as authors at their nations, customers as clusters of eight."""
    of = lambda name: table(spark, sf_dir, name)
    cited = references(spark, sf_dir).groupBy(F.col("cited").alias("o_orderkey")).agg(F.count("*").alias("citations"))
    orders = of("orders").join(cited, "o_orderkey", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    places = of("supplier").join(of("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(of("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    both = of("lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(places, F.col("s_suppkey") == F.col("l_suppkey"))
    return both.select(
        F.col("o_orderkey").alias("paper"),
        F.col("s_suppkey").alias("author"),
        F.col("n_name").alias("affiliation"),
        F.col("r_name").alias("country"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("type"),
        (F.col("o_custkey") % 8).alias("cluster"),
        F.col("o_custkey").alias("customer"),
        "citations",
    )


@query("WITH l AS (SELECT lower('K' || c_custkey) AS key, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 > 0), r AS (SELECT lower('k' || s_suppkey) AS key, s_name AS name, s_nationkey AS nation FROM supplier) SELECT DISTINCT coalesce(l.key, r.key) AS key, coalesce(l.name, r.name) AS name, segment, nation FROM l FULL JOIN r ON l.key = r.key WHERE nation IS NOT NULL")
def merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").selectExpr("concat('K', c_custkey) AS key", "c_name AS name", "c_mktsegment AS segment")
    right = table(spark, sf_dir, "supplier").selectExpr("concat('k', s_suppkey) AS key", "s_name AS name", "s_nationkey AS nation")
    return R.merge_tables(left, right, "key", required=["nation"])


@query("SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance, 'customer' AS origin FROM customer UNION ALL SELECT s_name, NULL, s_acctbal, 'supplier' FROM supplier")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tagged_union({"customer": table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_mktsegment AS segment"), "supplier": table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance")})


SEEN = "seen AS (SELECT o_orderkey AS paper FROM orders WHERE o_orderstatus = 'P')"


@query(f"WITH {REFERENCES}, {SEEN} SELECT cited AS paper, count(*) AS times FROM refs WHERE paper IN (SELECT paper FROM seen) AND cited NOT IN (SELECT paper FROM seen) GROUP BY ALL ORDER BY times DESC, paper LIMIT 50")
def hop_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_orderkey AS paper")
    return R.hop_candidates(references(spark, sf_dir), seen, seen, 50)


@query(f"WITH {REFERENCES}, {SEEN}, new AS (SELECT DISTINCT cited FROM refs WHERE paper IN (SELECT paper FROM seen) AND cited NOT IN (SELECT paper FROM seen)) SELECT a AS n_seen, b AS n_new, a + b AS n_total FROM (SELECT count(*) AS a FROM seen), (SELECT count(*) AS b FROM new)")
def hop_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hop_size(references(spark, sf_dir), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_orderkey AS paper"))


@query(f"WITH {LINES} SELECT 'country' AS kind, country AS value, count(DISTINCT paper) AS n_papers FROM lines GROUP BY ALL UNION ALL SELECT 'affiliation', affiliation, count(DISTINCT paper) FROM lines GROUP BY ALL")
def filter_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.suggestions(lines(spark, sf_dir), ["country", "affiliation"])


@query(f"WITH {LINES}, o AS (SELECT x.author, count(DISTINCT y.author) AS n FROM (SELECT DISTINCT paper, author FROM lines) x JOIN (SELECT DISTINCT paper, author FROM lines) y ON x.paper = y.paper AND x.author <> y.author GROUP BY ALL) SELECT lines.author, count(DISTINCT paper) AS n_papers, min(year) AS first_year, max(year) AS last_year, count(DISTINCT affiliation) AS n_affiliations, coalesce(max(n), 0) AS n_collaborators FROM lines LEFT JOIN o ON o.author = lines.author GROUP BY ALL")
def author_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.author_table(lines(spark, sf_dir))


IDS = "p AS (SELECT doc_id AS paper, (doc_id % 17) || '; ' || (doc_id * 7 % 23) || ';x' || ';' || (doc_id * 3 % 17) AS author_ids FROM documents)"


@query(f"WITH {IDS}, a AS (SELECT paper, trim(x) AS old, i FROM (SELECT paper, unnest(string_split(author_ids, ';')) AS x, generate_subscripts(string_split(author_ids, ';'), 1) AS i FROM p)), m AS (SELECT paper, 'S' || (old::INT // 2) AS new, min(i) AS i FROM a WHERE old <> 'x' GROUP BY ALL) SELECT paper, string_agg(new, ';' ORDER BY i) AS ids FROM m GROUP BY ALL")
def apply_author_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    papers = table(spark, sf_dir, "documents").select(d.alias("paper"), F.concat((d % 17).cast("string"), F.lit("; "), (d * 7 % 23).cast("string"), F.lit(";x;"), (d * 3 % 17).cast("string")).alias("author_ids"))
    ids = spark.range(23).selectExpr("CAST(id AS string) AS old", "concat('S', CAST(id DIV 2 AS string)) AS new")
    return R.apply_ids(papers, ids)


@query("WITH p AS (SELECT doc_id AS paper, unnest([0, 1]) AS pos, doc_id % 17 AS u, doc_id * 7 % 23 AS v, doc_id % 5 AS f, doc_id % 3 AS g FROM documents), r AS (SELECT paper, pos, CASE pos WHEN 0 THEN 'a' || u ELSE 'b' || v END AS author_id, CASE pos WHEN 0 THEN 'Ann ' || u ELSE 'Bob ' || v END AS author, f, g FROM p) SELECT paper, pos, author_id, author, 'f' || f AS affiliation_id, 'Institute ' || f AS affiliation, 'ES' AS country FROM r WHERE pos = 0 UNION ALL SELECT paper, pos, author_id, author, 'g', 'Other', NULL FROM r WHERE g = 0 UNION ALL SELECT paper, pos, author_id, author, NULL, NULL, NULL FROM r WHERE pos = 1 AND g > 0")
def author_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    a, b = text("a", d % 17), text("b", d * 7 % 23)
    place = lambda i, n, c, who: F.struct(i.alias("id"), n.alias("name"), c.alias("country"), who.alias("authors"))
    first = place(text("f", d % 5), text("Institute ", d % 5), F.lit("ES"), F.array(a))
    second = place(F.lit("g"), F.lit("Other"), F.lit(None).cast("string"), F.when(d % 3 == 0, F.array(a, b)).otherwise(F.array().cast("array<string>")))
    papers = table(spark, sf_dir, "documents").select(d.alias("paper"), F.concat(a, F.lit("; "), b).alias("author_ids"), F.concat(text("Ann ", d % 17), F.lit(";"), text("Bob ", d * 7 % 23)).alias("authors"), F.array(first, second).alias("affiliations"))
    return R.author_lines(papers)


NAMES = "names AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || (p_partkey % 30) AS value FROM part)"


@query(f"WITH {NAMES}, l AS (SELECT value FROM names WHERE ascii(right(value, 1)) % 2 = 0), r AS (SELECT value FROM names WHERE ascii(right(value, 1)) % 2 = 1), m AS (SELECT l.value, r.value AS other, levenshtein(l.value, r.value) AS d FROM l JOIN r ON abs(length(l.value) - length(r.value)) <= 1 AND levenshtein(l.value, r.value) <= 1), b AS (SELECT value, arg_min(other, d * 1000000 + rank) AS match, min(d) AS d FROM (SELECT *, rank() OVER (ORDER BY other) AS rank FROM m) GROUP BY value) SELECT l.value, match, d FROM l LEFT JOIN b ON b.value = l.value")
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").selectExpr("concat(p_name, ' ', p_type, ' ', p_partkey % 30) AS value").distinct()
    return R.fuzzy_join(names.where("ascii(right(value, 1)) % 2 = 0"), names.where("ascii(right(value, 1)) % 2 = 1").withColumnRenamed("value", "other"), ("value", "other"))


@query(f"WITH RECURSIVE {NAMES}, e AS MATERIALIZED (SELECT a.value AS a, b.value AS b FROM names a JOIN names b ON abs(length(a.value) - length(b.value)) <= 1 AND levenshtein(a.value, b.value) <= 1), g AS (SELECT a, b FROM e UNION SELECT g.a, e.b FROM g JOIN e ON e.a = g.b) SELECT a AS value, min(b) AS \"group\" FROM g GROUP BY ALL")
def fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuzzy_groups(table(spark, sf_dir, "part").selectExpr("concat(p_name, ' ', p_type, ' ', p_partkey % 30) AS value"), "value")


@query(
    f"WITH {LINES}, f AS (SELECT DISTINCT paper, c_mktsegment || ' ' || n_regionkey AS funder, n_regionkey::VARCHAR AS country, year, citations FROM lines JOIN customer ON c_custkey = customer JOIN nation ON n_nationkey = c_nationkey), s AS (SELECT paper, 1.0 / count(DISTINCT funder) AS share FROM f GROUP BY ALL) "
    "SELECT funder, country, year, count(DISTINCT paper) AS paper_count, sum(citations)::BIGINT AS num_citations, round(avg(share::DOUBLE), 6) AS attribution FROM f JOIN s USING (paper) GROUP BY ALL"
)
def funder_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of regions as funders; every seventh name is written in another way."""
    own = lines(spark, sf_dir).select("paper", "customer", "year", "citations").distinct()
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    name = F.concat("c_mktsegment", F.lit(" "), F.col("n_regionkey").cast("string"))
    written = F.when(F.col("paper") % 7 == 0, F.concat(F.lower(name), F.lit("."))).when(F.col("paper") % 7 == 1, F.replace(name, F.lit(" "), F.lit(" - "))).otherwise(name)
    funding = own.join(customers, F.col("c_custkey") == F.col("customer")).select("paper", written.alias("funder"), F.col("n_regionkey").cast("string").alias("country"), "year", "citations")
    return R.funder_table(funding).withColumn("attribution", F.round("attribution", 6))


@query(f"WITH {LINES} SELECT affiliation, max(country) AS country, count(DISTINCT paper) AS n_papers, count(DISTINCT author) AS n_authors FROM lines GROUP BY affiliation")
def place_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.place_counts(lines(spark, sf_dir))


@query(f"WITH {LINES}, p AS (SELECT DISTINCT cluster, paper, type, citations FROM lines), a AS (SELECT cluster, count(*) AS n_papers, sum((type = 0)::INT)::BIGINT AS n_core, sum(citations)::BIGINT AS citations FROM p GROUP BY ALL) SELECT a.*, n_authors, n_affiliations, n_countries FROM a JOIN (SELECT cluster, count(DISTINCT author) AS n_authors, count(DISTINCT affiliation) AS n_affiliations, count(DISTINCT country) AS n_countries FROM lines GROUP BY ALL) USING (cluster)")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cluster_table(lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT type, count(DISTINCT paper) AS n_papers, count(DISTINCT author) AS n_authors, count(DISTINCT affiliation) AS n_affiliations, count(DISTINCT country) AS n_countries FROM lines GROUP BY ALL")
def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.type_summary(lines(spark, sf_dir))


def _top(group: str, key: str) -> str:
    return f"WITH {LINES}, o AS (SELECT DISTINCT {group}, {key}, paper, citations FROM lines), s AS (SELECT {group}, {key}, count(*) AS n_papers, sum(citations)::BIGINT AS citations FROM o GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY citations DESC, n_papers DESC, {key}) AS place FROM s) WHERE place <= 5"


@query(_top("cluster", "author"))
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_in_cluster(lines(spark, sf_dir), "author", 5)


@query(_top("country", "affiliation"))
def top_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_in_cluster(lines(spark, sf_dir), "affiliation", 5, "country")


@query(
    "WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(html, '')), '\\s+'), lambda t: t <> '') AS w FROM (SELECT page_id AS doc_id, html FROM pages)), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM d), "
    "p AS (SELECT doc_id, gram, count(*) AS n FROM g WHERE len(list_filter(string_split_regex(gram, '[ -]'), lambda x: x <> '')) = 2 GROUP BY ALL) SELECT gram, sum(n)::BIGINT AS tf, count(*) AS df FROM p GROUP BY ALL"
)
def hyphen_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hyphen_grams(table(spark, sf_dir, "pages"), 2, "page_id", "html")


@query(f"WITH {POSTINGS}, n AS (SELECT count(*) AS n FROM documents) SELECT token AS term, sum(tf)::BIGINT AS tf, count(*) AS df, round(sum(tf) * (ln((1.0 + max(n)) / (1.0 + count(*))) + 1.0) / max(n), 6) AS weight FROM p, n WHERE token IN ({quoted(TERMS)}) GROUP BY ALL")
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_weights(table(spark, sf_dir, "documents"), TERMS).withColumn("weight", F.round("weight", 6))


@query("SELECT event_type AS key, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each user as a map, summed over users."""
    by = table(spark, sf_dir, "events").where("event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.merge_counts(by.select(F.create_map("event_type", "n").alias("counts")), "counts")


@query("WITH v AS (SELECT embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT list_position(e, list_max(e)) - 1 AS cluster, list_max(e) / list_sum(list_transform(e, lambda x: abs(x))) AS share FROM v) SELECT cluster, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 6) AS percent, round(avg(share), 6) AS mean_share FROM c GROUP BY ALL")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = R.cluster_sizes(R.assign_clusters(rows))
    return out.withColumn("percent", F.round("percent", 6)).withColumn("mean_share", F.round("mean_share", 6))


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT a.i::INT AS i, b.i::INT AS j, round(corr(a.x, b.x), 6) AS r FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL")
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.correlations(table(spark, sf_dir, "embeddings")).withColumn("r", F.round("r", 6))


SALES = "sales AS (SELECT c_nationkey AS k, l_suppkey AS col, sum(l_quantity) AS h FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL), known AS (SELECT DISTINCT o_custkey AS \"row\", l_suppkey AS col FROM lineitem JOIN orders ON o_orderkey = l_orderkey), users AS (SELECT c_custkey AS \"row\", c_nationkey AS k, 0.5 AS w FROM customer), bias AS (SELECT l_suppkey AS col, count(*) * 0.01 AS b FROM lineitem GROUP BY ALL)"


@query(f"WITH {SALES}, s AS (SELECT \"row\", col, sum(w * h) + max(coalesce(b, 0)) + 3 AS score FROM users JOIN sales USING (k) LEFT JOIN bias USING (col) GROUP BY ALL) SELECT \"row\", col, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY \"row\" ORDER BY score DESC, col) AS place FROM s ANTI JOIN known USING (\"row\", col)) WHERE place <= 5")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers a customer has not bought from, by what the customer's nation buys there."""
    orders = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    with shuffles_dropped(spark):
        bought = written(orders.groupBy(F.col("o_custkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("h")))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_nationkey").alias("k"))
    sales = bought.join(customers, "row").groupBy("k", "col").agg(F.sum("h").alias("h"))
    bias = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("col")).agg((F.count("*") * 0.01).alias("b"))
    return R.top_predicted(customers.withColumn("w", F.lit(0.5)), sales, bought, 5, col_bias=bias, mean=3.0).withColumn("score", F.round("score", 6))


FACTORS = "x AS (SELECT o_custkey % 40 AS \"row\", l_suppkey AS col, sum(l_quantity) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), w AS (SELECT DISTINCT \"row\", k, 1.0 + (\"row\" * 3 + k) % 5 AS w FROM x, range(3) r(k)), h AS (SELECT DISTINCT k, col, 2.0 + (col + k * 7) % 11 AS h FROM x, range(3) r(k))"


@query(f"WITH {FACTORS}, y AS (SELECT \"row\", col, sum(w * h) AS y FROM w JOIN h USING (k) GROUP BY ALL), c AS (SELECT coalesce(v, 0) AS v, y FROM y LEFT JOIN x USING (\"row\", col)) SELECT round(sum(CASE WHEN v > 0 THEN v * ln(v / y) ELSE 0 END - v + y), 4) AS kl, round(sqrt(sum((v - y) * (v - y))) / sqrt(sum(v * v)), 6) AS error FROM c")
def factor_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = orders.groupBy((F.col("o_custkey") % 40).alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("v"))
    ranks = F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("k")
    w = x.select("row").distinct().select("row", ranks).withColumn("w", 1.0 + (F.col("row") * 3 + F.col("k")) % 5)
    h = x.select("col").distinct().select("col", ranks).withColumn("h", 2.0 + (F.col("col") + F.col("k") * 7) % 11)
    return R.divergence(x, w, h).select(F.round("kl", 4).alias("kl"), F.round("error", 6).alias("error"))


CELLS = "c AS (SELECT o_custkey AS \"row\", l_suppkey AS col, sum(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE l_quantity END) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), u AS (SELECT * FROM c WHERE v <> 0)"


@query(f"WITH {CELLS}, r AS (SELECT \"row\", row_number() OVER (ORDER BY \"row\") - 1 AS i FROM (SELECT DISTINCT \"row\" FROM u)), k AS (SELECT col, row_number() OVER (ORDER BY col) - 1 AS j FROM (SELECT DISTINCT col FROM u)) SELECT i, j, v FROM u JOIN r USING (\"row\") JOIN k USING (col)")
def compact_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    cells = orders.groupBy(F.col("o_custkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum(F.when(F.col("o_custkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity"))).alias("v"))
    return R.compact(cells)[0]


@query("WITH f AS (SELECT l_suppkey AS author, min({'a': l_orderkey, 'b': l_linenumber, 'c': l_suppkey}) AS first FROM lineitem GROUP BY ALL) SELECT author, row_number() OVER (ORDER BY first) - 1 AS idx FROM f")
def mode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "author")
    return R.first_seen(rows, "author", "l_orderkey", "l_linenumber", "author")


@query("SELECT sqrt(avg((l_quantity * 1000 - l_extendedprice) ** 2)) AS rmse, avg(abs(l_quantity * 1000 - l_extendedprice)) AS mae, count(*) AS n FROM lineitem")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.error_metrics(table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1000), "l_extendedprice", "guess")


@query(
    "WITH s AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), b AS (SELECT n_chars, sum((quality = 1)::INT)::DOUBLE AS p, sum((quality = 0)::INT)::DOUBLE AS q FROM s GROUP BY ALL), c AS (SELECT p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM b WINDOW w AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)), "
    "d AS (SELECT p, q, tp, tp / (tp + fp) AS r1, CASE WHEN tp + fp - p - q > 0 THEN (tp - p) / (tp + fp - p - q) ELSE 1.0 END AS r0 FROM c) SELECT round(sum(q * (2 * tp - p) / 2) / (sum(p) * sum(q)), 9) AS roc_auc, round(sum(p * (r1 + r0) / 2) / sum(p), 9) AS pr_auc FROM d"
)
def curve_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return R.curve_areas(rows, "quality", "n_chars").select(F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT') SELECT 'union' AS kind, count(*) AS n, sum(id)::BIGINT AS total FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'intersection', count(*), sum(id)::BIGINT FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'difference', count(*), sum(id)::BIGINT FROM (SELECT id FROM a EXCEPT SELECT id FROM b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    a, b = (orders.where(c).select(F.col("o_custkey").alias("id")) for c in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'"))
    sets = R.tagged_union({"union": a.union(b).distinct(), "intersection": a.intersect(b), "difference": a.subtract(b)}, "kind")
    return sets.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query(f"WITH d AS (SELECT lang, unnest({LOW}) AS word FROM documents), c AS (SELECT lang, word, count(*) AS tf FROM d GROUP BY ALL) SELECT * FROM (SELECT lang, word, tf, row_number() OVER (PARTITION BY lang ORDER BY tf DESC, word) AS place FROM c) WHERE place <= 10")
def words_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tensor.entity_word_time(table(spark, sf_dir, "documents").withColumn("all", F.lit(0)), "lang", "all").select("lang", "word", F.col("n").alias("tf"))
    place = F.row_number().over(R.Window.partitionBy("lang").orderBy(F.desc("tf"), "word"))
    return counts.withColumn("place", place).where(F.col("place") <= 10)
