"""Queries of matrices, tensors and graphs by slice, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import ranks
from ..graph.components import connected_components
from ..operators import consensus as agreement
from ..operators import ensemble, evidence, factor, similar, stats, tensor
from .queries import EDGES, LABELS, LOW, NODES, PAPERS, POSTINGS, edges, hits_rounds, papers, query, rank_rounds, table
from .report_queries import FACTORS, LINES, lines


@query(
    f"WITH {POSTINGS}, n AS (SELECT count(*) AS n FROM documents), w AS (SELECT token, count(*) AS df FROM p GROUP BY ALL HAVING count(*) >= 20), r AS (SELECT doc_id, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM p JOIN w USING (token), n) "
    "SELECT doc_id, token, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) * CASE token WHEN 'the' THEN 3.0 WHEN 'und' THEN 0.5 ELSE 1.0 END, 6) AS weight FROM r"
)
def highlighted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tensor.tf_idf(table(spark, sf_dir, "documents"), 20)
    return tensor.highlighted(weights, {"the": 3.0, "und": 0.5}).select("doc_id", "token", F.round("weight", 6).alias("weight"))


@query(f"WITH p AS (SELECT source, token, count(*) AS tf FROM (SELECT source, unnest({LOW}) AS token FROM documents) GROUP BY ALL), n AS (SELECT count(DISTINCT source) AS n FROM documents), w AS (SELECT token, count(*) AS df FROM p GROUP BY ALL), r AS (SELECT source, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM p JOIN w USING (token), n) SELECT source, token, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY source)), 6) AS weight FROM r")
def entity_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.entity_tf_idf(table(spark, sf_dir, "documents"), "source").withColumn("weight", F.round("weight", 6))


@query("WITH p AS (SELECT doc_id % 7 AS year, ['a' || (doc_id % 17), 'b' || (doc_id * 7 % 23), 'a' || (doc_id * 3 % 17)] AS x FROM documents), q AS (SELECT year, unnest([[x[1], x[2]], [x[2], x[1]], [x[1], x[3]], [x[3], x[1]], [x[2], x[3]], [x[3], x[2]]]) AS e FROM p) SELECT e[1] AS a, e[2] AS b, year, count(*) AS n FROM q GROUP BY ALL")
def positional_co_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    rows = table(spark, sf_dir, "documents").select((d % 7).alias("year"), F.concat(name("a", d % 17), F.lit("; ; "), name("b", d * 7 % 23), F.lit(";"), name("a", d * 3 % 17)).alias("author_ids"))
    return tensor.positional_pairs(rows)


@query(f"WITH {PAPERS} SELECT x.author AS a, y.author AS b, count(*) AS n FROM papers x JOIN papers y ON x.paper = y.paper AND x.author <> y.author GROUP BY ALL")
def flat_co_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.flatten_time(tensor.co_authors(papers(spark, sf_dir)))


@query("SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL")
def co_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.co_dependency(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("WITH c AS (SELECT c_nationkey AS stratum, count(DISTINCT (o_custkey, month(o_orderdate))) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT stratum, n AS n_cells, floor(n * 0.3)::BIGINT AS n_removed FROM c")
def sampled_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each stratum has and how many the mask takes out."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    cells = rows.groupBy(F.col("c_nationkey").alias("stratum"), F.col("o_custkey").alias("row"), F.month("o_orderdate").alias("col")).agg(F.count("*").alias("v"))
    masked = tensor.sample_mask(cells, 0.3, "stratum")
    return masked.groupBy("stratum").agg(F.count("*").alias("n_cells"), F.sum(1 - F.col("mask")).alias("n_removed"))


@query("SELECT month(o_orderdate) AS i, c_nationkey AS j, (o_custkey % 7) AS t, count(*) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def moved_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    cells = rows.groupBy(F.col("c_nationkey").alias("i"), (F.col("o_custkey") % 7).alias("j"), F.month("o_orderdate").alias("t")).agg(F.count("*").alias("v"))
    return tensor.move_axis(cells, ("t", "i", "j"))


@query(
    "WITH v AS (SELECT label AS id, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), d AS (SELECT a.id AS i, b.id AS j, sum((a.x - b.x) ** 2) AS dd FROM v a JOIN v b ON a.i = b.i AND a.id <> b.id GROUP BY ALL), "
    "s AS (SELECT i, sqrt(dd) AS s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(dd, 12), j) AS r FROM d) WHERE r = 3) SELECT d.i, d.j, round(exp(-dd / (x.s * y.s)), 6) AS value FROM d JOIN s x ON x.i = d.i JOIN s y ON y.i = d.j"
)
def affinity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affinities of the mean vectors of the labels."""
    from ..operators import vectors

    means = vectors.centroids(table(spark, sf_dir, "embeddings"), "label").select(F.col("label").alias("id"), F.col("centroid").alias("x"))
    return tensor.affinities(means, 3).withColumn("value", F.round("value", 6))


@query(
    f"WITH {EDGES}, {NODES}, o AS (SELECT src, sum(weight) AS w FROM e GROUP BY ALL), {rank_rounds(6)}, {hits_rounds(6)}, i AS (SELECT dst AS node, count(*) AS k FROM e GROUP BY ALL), u AS (SELECT src AS node, count(*) AS k FROM e GROUP BY ALL) "
    "SELECT node, coalesce(i.k, 0) AS in_degree, coalesce(u.k, 0) AS out_degree, round(r, 9) AS rank, round(coalesce(h, 0), 9) AS hub, round(coalesce(a, 0), 9) AS authority, s_name AS name FROM nodes LEFT JOIN i USING (node) LEFT JOIN u USING (node) LEFT JOIN r6 USING (node) LEFT JOIN h6 USING (node) LEFT JOIN a6 USING (node) LEFT JOIN supplier ON s_suppkey = node"
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    out = ranks.stat_table(edges(spark, sf_dir), names, rounds=6, tolerance=0)
    return out.select("node", "in_degree", "out_degree", *(F.round(c, 9).alias(c) for c in ("rank", "hub", "authority")), "name")


SLICES = "e AS (SELECT year(l_shipdate) % 3 AS slice, l_suppkey AS src, l_partkey % 19 + 1 AS dst, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY ALL HAVING sum(l_quantity) >= 30)"


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.year("l_shipdate") % 3).alias("slice"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 19 + 1).alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return rows.where("weight >= 30")


def slice_rounds(n: int, keys: str) -> str:
    out = [f"nodes AS (SELECT {keys}, src AS node FROM e UNION SELECT {keys}, dst FROM e), c AS (SELECT {keys}, count(*) AS n FROM nodes GROUP BY ALL), o AS (SELECT {keys}, src, sum(weight) AS w FROM e GROUP BY ALL), r0 AS (SELECT {keys}, node, 1.0::DOUBLE / n AS r FROM nodes JOIN c USING ({keys}))"]
    for k in range(1, n + 1):
        out.append(
            f"g{k} AS (SELECT {keys}, dst AS node, sum(r * weight / w) AS g FROM e JOIN o USING ({keys}, src) JOIN (SELECT {keys}, node AS src, r FROM r{k - 1}) USING ({keys}, src) GROUP BY ALL), s{k} AS (SELECT {keys}, sum(g) AS s FROM g{k} GROUP BY ALL), "
            f"r{k} AS (SELECT {keys}, node, 0.85 * (coalesce(g, 0) + (1 - s) / n) + 0.15 / n AS r FROM nodes JOIN c USING ({keys}) JOIN s{k} USING ({keys}) LEFT JOIN g{k} USING ({keys}, node))"
        )
    return ", ".join(out)


@query(f"WITH {SLICES}, {slice_rounds(5, 'slice')}, i AS (SELECT slice, dst AS node, count(*) AS k FROM e GROUP BY ALL) SELECT slice, node, coalesce(k, 0) AS in_degree, round(r, 9) AS rank FROM r5 LEFT JOIN i USING (slice, node)")
def slice_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-degree and PageRank of each node in each slice."""
    own = slices(spark, sf_dir)
    out = ranks.pagerank(own, rounds=5, tolerance=0, by=["slice"]).join(ranks.degrees(own, ["slice"]), ["slice", "node"])
    return out.select("slice", "node", "in_degree", F.round("rank", 9).alias("rank"))


@query(
    f"WITH a AS (SELECT slice, src AS i, dst AS j, weight AS v FROM ({SLICES.removeprefix('e AS (').removesuffix(')')})), t AS (SELECT i % 3 AS community, i AS node, sum(v) AS s FROM a GROUP BY ALL UNION ALL SELECT j % 3, j, sum(v) FROM a GROUP BY ALL), u AS (SELECT community, node, sum(s) AS s FROM t GROUP BY ALL), m AS (SELECT community, node FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY s DESC, node) AS r FROM u) WHERE r <= 12), "
    f"e AS (SELECT x.community, slice, i AS src, j AS dst, v AS weight FROM a JOIN m x ON x.node = i JOIN m y ON y.node = j AND y.community = x.community), {slice_rounds(4, 'community, slice')} SELECT community, slice, node, round(r, 9) AS rank FROM r4"
)
def community_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank among the twelve heaviest nodes of each community, in each slice."""
    cells = slices(spark, sf_dir).select(F.col("src").alias("i"), F.col("dst").alias("j"), "slice", F.col("weight").alias("v"))
    heavy = cells.select(F.col("i").alias("node"), "v").unionByName(cells.select(F.col("j").alias("node"), "v")).groupBy((F.col("node") % 3).alias("community"), "node").agg(F.sum("v").alias("s"))
    members = stats.top_per_group(heavy, "community", [F.desc("s"), "node"], 12)
    own = ranks.community_edges(cells, members)
    return ranks.pagerank(own, rounds=4, tolerance=0, by=["community", "slice"]).withColumn("rank", F.round("rank", 9))


@query(f"WITH {LINES}, k AS (SELECT author, affiliation, max(country) AS country, count(DISTINCT paper) AS c FROM lines GROUP BY ALL) SELECT author, affiliation, country FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY c DESC, affiliation) AS r FROM k) WHERE r = 1")
def node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.node_attributes(lines(spark, sf_dir))


@query("WITH g AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 9 ELSE c_custkey END AS home FROM customer), e AS (SELECT node, home FROM g WHERE node <> home UNION SELECT home, home FROM g WHERE node <> home), c AS (SELECT node, home AS component, count(*) OVER (PARTITION BY home) AS size FROM e) SELECT node, component, size, dense_rank() OVER (ORDER BY size DESC, component) AS place FROM c")
def sized_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth customer points to one of nine; others stand alone."""
    links = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey AS src", "c_custkey % 9 AS dst")
    return ranks.component_sizes(connected_components(links))


def factor_start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (i, j, v) of customers by suppliers, and factors of rank 3 to start from."""
    orders = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = orders.groupBy((F.col("o_custkey") % 40).alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    w = x.select("i").distinct().select("i", F.array(*(1.0 + (F.col("i") * 3 + k) % 5 for k in range(3))).alias("w"))
    h = x.select("j").distinct().select("j", F.array(*(2.0 + (F.col("j") + k * 7) % 11 for k in range(3))).alias("h"))
    return x, w, h


def factor_rows(w: DataFrame, h: DataFrame) -> DataFrame:
    one = lambda df, key, name: df.select(F.lit(name).alias("side"), F.col(key).alias("key"), F.posexplode(name).alias("k", "value"))
    return one(w, "i", "w").unionByName(one(h, "j", "h")).select("side", "key", F.col("k").cast("long").alias("k"), F.round("value", 6).alias("value"))


GRAM_W = "SELECT a.k, b.k AS l, sum(a.w * b.w) AS g FROM w a JOIN w b ON a.\"row\" = b.\"row\" GROUP BY ALL"
SIDES = "SELECT 'w' AS side, \"row\" AS key, k, round(w, 6) AS value FROM w1 UNION ALL SELECT 'h', col, k, round(h, 6) FROM h1"


@query(
    f"WITH {FACTORS}, gw AS ({GRAM_W}), up AS (SELECT k, col, sum(w * v) AS n FROM x JOIN w USING (\"row\") GROUP BY ALL), down AS (SELECT gw.k, col, sum(g * h) AS d FROM gw JOIN h ON h.k = gw.l GROUP BY ALL), h1 AS (SELECT h.k, h.col, h * coalesce(n, 0) / d AS h FROM h JOIN down USING (k, col) LEFT JOIN up USING (k, col)), "
    f"gh AS (SELECT a.k, b.k AS l, sum(a.h * b.h) AS g FROM h1 a JOIN h1 b USING (col) GROUP BY ALL), up2 AS (SELECT \"row\", k, sum(h * v) AS n FROM x JOIN h1 USING (col) GROUP BY ALL), down2 AS (SELECT \"row\", gh.k, sum(g * w) AS d FROM gh JOIN w ON w.k = gh.l GROUP BY ALL), w1 AS (SELECT \"row\", w.k, w * coalesce(n, 0) / d AS w FROM w JOIN down2 USING (\"row\", k) LEFT JOIN up2 USING (\"row\", k)) {SIDES}"
)
def nmf_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of Frobenius updates, h first."""
    x, w, h = factor_start(spark, sf_dir)
    w, h, _ = factor.distributed_nmf(x, 3, 1, start=(w, h))
    return factor_rows(w, h)


@query(
    f"WITH {FACTORS}, y AS (SELECT \"row\", col, max(v) / sum(w * h) AS q FROM x JOIN w USING (\"row\") JOIN h USING (k, col) GROUP BY ALL), s AS (SELECT k, sum(w) AS s FROM w GROUP BY ALL), h1 AS (SELECT h.k, h.col, max(h) * coalesce(sum(w * q), 0) / max(s) AS h FROM h JOIN s USING (k) LEFT JOIN y USING (col) LEFT JOIN w ON w.\"row\" = y.\"row\" AND w.k = h.k GROUP BY ALL), "
    f"z AS (SELECT \"row\", col, max(v) / sum(w * h) AS q FROM x JOIN w USING (\"row\") JOIN h1 USING (k, col) GROUP BY ALL), t AS (SELECT k, sum(h) AS s FROM h1 GROUP BY ALL), w1 AS (SELECT w.\"row\", w.k, max(w) * coalesce(sum(h * q), 0) / max(s) AS w FROM w JOIN t USING (k) LEFT JOIN z USING (\"row\") LEFT JOIN h1 ON h1.col = z.col AND h1.k = w.k GROUP BY ALL) {SIDES}"
)
def nmf_kullback_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of Kullback-Leibler updates, h first."""
    x, w, h = factor_start(spark, sf_dir)
    return factor_rows(*factor.distributed_kullback(x, 3, 1, (w, h)))


@query(
    "WITH RECURSIVE n AS (SELECT DISTINCT n_name AS s FROM nation UNION SELECT DISTINCT r_name FROM region), p AS (SELECT a.s AS a, b.s AS b FROM n a, n b WHERE length(a.s) >= 4), "
    "w AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0::BIGINT) AS r FROM p UNION ALL "
    "SELECT a, b, i + 1, list_transform(range(length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0::BIGINT ELSE list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], r[k] + CASE WHEN substring(a, i + 1, 1) = substring(b, k, 1) THEN 1 ELSE 0 END))) END) FROM w WHERE i < length(a)), "
    "d AS (SELECT a, b, 1 - 2 * r[length(b) + 1] / (length(a) + length(b)) AS distance FROM w WHERE i = length(a)) SELECT a, b, round(distance, 9) AS distance FROM d WHERE distance <= 0.45 + 1e-12"
)
def name_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations and regions whose normalized Indel distance is 0.45 or less."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("value")))
    return similar.ratio_pairs(names.where("length(value) >= 4"), names, 0.45).withColumn("distance", F.round("distance", 9))


def repeated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five clusterings of the customers."""
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run"))
    return runs.select("run", "i", F.expr("(i div (run + 1)) % 4").alias("label"))


@query(f"WITH l AS (SELECT run, c_custkey AS i, {LABELS} AS label FROM customer, range(5) r(run)), p AS (SELECT v, count(*) AS n FROM (SELECT i, list(label ORDER BY run) AS v FROM l GROUP BY ALL) GROUP BY v), s AS (SELECT list_sum(list_transform(range(1, 6), lambda k: (x.v[k] = y.v[k])::INT)) / 5 AS together, CASE WHEN x.v = y.v THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS pairs FROM p x JOIN p y ON x.v <= y.v) SELECT round(sum(CASE WHEN together > 0.1 AND together < 0.9 THEN pairs ELSE 0 END) / sum(pairs), 9) AS pac, sum(pairs)::BIGINT AS pairs FROM s")
def consensus_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.ambiguous_share(repeated_labels(spark, sf_dir)).withColumn("pac", F.round("pac", 9))


@query()
def consensus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the order of the average linkage of their agreement."""
    return agreement.average_linkage(repeated_labels(spark, sf_dir))[1].select(F.col("i").alias("c_custkey"), "place")


@query("WITH d AS (SELECT l_returnflag AS flag, l_quantity::DOUBLE - (l_partkey % 50 + 1) AS d FROM lineitem), r AS (SELECT flag, d, rank() OVER (PARTITION BY flag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY flag, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY flag, abs(d)) AS t FROM d WHERE d <> 0), s AS (SELECT flag, count(*)::BIGINT AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY flag), z AS (SELECT flag, count(*) FILTER (d = 0) AS n_zero FROM d GROUP BY flag) SELECT flag, n, n_zero, w_plus, w_minus, round((least(w_plus, w_minus) - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s JOIN z USING (flag)")
def signed_rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 50 + 1).alias("y"))
    return evidence.signed_ranks(pairs, ["flag"]).select("flag", "n", "n_zero", "w_plus", "w_minus", F.round("z", 6).alias("z"))


@query("WITH s AS (SELECT unnest([struct_pack(feature := 0, v := 4 * var_pop(l_quantity::DOUBLE)), struct_pack(feature := 1, v := 0.0), struct_pack(feature := 2, v := 2500 * var_pop(l_linenumber))], recursive := true) FROM lineitem) SELECT feature, row_number() OVER (ORDER BY v DESC)::INT AS place FROM s")
def important_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by importance for a number that two of three make up; in SQL by their share of its variance."""
    lines = table(spark, sf_dir, "lineitem")
    quantity, other, number = (F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_linenumber"))
    rows = lines.select(F.struct("l_orderkey", "l_linenumber").alias("j"), F.array(quantity, other, number).alias("h"), (2 * quantity + 50 * number).alias("y"))
    found = evidence.importances(rows.select("j", "h"), rows.select("j", "y"), repeats=1)
    return found.select("feature", F.row_number().over(Window.orderBy(F.desc("importance"))).alias("place"))


@query("SELECT DISTINCT 'n' || (c_nationkey % 2) AS node, (2 + c_nationkey % 2)::INT AS rank FROM customer")
def planted_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank that the ensemble of each node finds in blocks of customers by columns; in SQL the number of blocks."""
    blocks, customer = F.col("c_nationkey") % 2 + 2, F.col("c_custkey")
    column = F.explode(F.sequence(F.lit(0), F.lit(5)))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), (F.col("c_nationkey") % 2).cast("string")).alias("node"), customer.alias("i"), (customer % blocks).alias("b"), column.alias("k"))
    cells = rows.select("node", "i", (F.col("k") * 10 + F.col("b")).cast("long").alias("j"), ((1 + F.col("i") % 5) * (1 + F.col("k") % 4)).cast("double").alias("v"))
    return ensemble.select_ranks(cells, [2, 3, 4], runs=3, rounds=6)[0].where("selected").select("node", "rank")
