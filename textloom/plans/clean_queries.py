"""Queries of cleaning steps and text rules, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import text
from ..sources import rules
from .queries import POSTINGS, STOP_WORDS, query, quoted, table


def _steps(expression: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        expression = f"regexp_replace({expression}, '{pattern}', '{new}', 'g')"
    return expression


@query("SELECT doc_id, " + _steps("trim(strip_accents(" + _steps("coalesce(text, '')", ("(?i)all rights reserved", ""), ("(?i)th[ae]t", "")) + "))", ("[()]", " "), ("[\\[\\]]", " "), ("\\\\", " "), ("-", ""), ("\\s+", " ")) + " AS cleaned FROM documents")
def clean_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [T.remove_stop_phrases(["all rights reserved", "th[ae]t"]), T.remove_accents, F.trim, *map(T.pattern_step, ("remove_()", "remove_[]", "remove_\\", "remove_dash", "remove_extra_whitespace"))]
    cleaned = F.coalesce("text", F.lit(""))
    for step in steps:
        cleaned = step(cleaned)
    return table(spark, sf_dir, "documents").select("doc_id", cleaned.alias("cleaned"))


@query(
    "WITH d AS (SELECT doc_id, replace(translate(coalesce(text, ''), '0123456789', '0123456789'), '-', ' - ') AS t FROM documents WHERE lang = 'en' AND NOT regexp_matches(text, '[^\\x00-\\x7F]')) SELECT doc_id, "
    + _steps("t", ("\\b\\d+\\b", ""), ("(?i)\\bM{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\\b", ""), ("\\n+", " "), ("\\b\\w*[=/\\\\]\\w*\\b", ""))
    + " AS cleaned FROM d"
)
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII texts, for which both engines have the same word boundaries."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    cleaned = F.replace("text", F.lit("-"), F.lit(" - "))
    for name in ("remove_numbers", "remove_roman_numerals", "remove_next_line", "remove_formulas"):
        cleaned = T.pattern_step(name)(cleaned)
    return docs.select("doc_id", cleaned.alias("cleaned"))


@query(f"WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\pL\\pN\\pM_]([\\pL\\pN\\pM_-]*[\\pL\\pN\\pM_])?') AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda t: len(list_intersect(string_split(lower(t), '-'), [{quoted(STOP_WORDS)}])) = 0), ' ') AS cleaned FROM d")
def clean_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.remove_stop_words(STOP_WORDS)(F.coalesce("text", F.lit(""))).alias("cleaned"))


FROZEN = ["License", "The"]


@query(f"WITH d AS (SELECT doc_id, replace(replace(text, 'License', chr(57345)), 'Apache', chr(57346)) AS t FROM documents WHERE regexp_matches(text, 'License')) SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(replace(replace(regexp_replace(t, '[A-Za-z]*ic[A-Za-z]*', '_', 'g'), chr(57345), 'License'), chr(57346), 'Apache'), '\\s+'), lambda x: x <> ''), lambda x: CASE WHEN x IN ({quoted(FROZEN)}) THEN x ELSE lower(x) END), ' ') AS cleaned FROM d")
def clean_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with ``ic`` are replaced, but not inside frozen terms; tokens in FROZEN keep their case."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("License")))
    cleaned = T.regex_step("[A-Za-z]*ic[A-Za-z]*", "_", ["License", "Apache"])(F.col("text"))
    return docs.select("doc_id", T.lower_case(FROZEN)(cleaned).alias("cleaned"))


@query("WITH d AS (SELECT doc_id, text AS t FROM documents WHERE contains(text, 'License')) SELECT doc_id, regexp_replace(regexp_replace(t, '[^\\pL]License', ' License', 'g'), 'License[^\\pL]', 'License ', 'g') AS cleaned FROM d")
def isolate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("License")))
    return docs.select("doc_id", T.isolate_terms(["License"])(F.col("text")).alias("cleaned"))


LEMMAS = {"there": "here", "thing": "thin", "ones": "one", "erste": "erst"}


@query(f"WITH d AS (SELECT doc_id, list_filter(string_split_regex(replace(coalesce(text, ''), ' - ', '-'), '\\s+'), lambda t: t <> '') AS w FROM documents) SELECT doc_id, array_to_string(list_transform(w, lambda t: CASE t {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in LEMMAS.items())} ELSE t END), ' ') AS lemmas FROM d")
def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.lemmatize(LEMMAS)(F.coalesce("text", F.lit(""))).alias("lemmas"))


def _whole(expression: str, word: str, new: str) -> str:
    once = "regexp_replace({}, '(^|[^\\pL\\pN\\pM_])" + word + "([^\\pL\\pN\\pM_]|$)', '\\1' || " + new + " || '\\2', 'g')"
    return once.format(once.format(expression))


@query(f"SELECT doc_id, {_whole(_whole(_whole('text', 'the', chr(39) + 'le' + chr(39)), 'and', 'chr(38) || (doc_id % 3)::VARCHAR'), 'of', chr(39) + 'de$' + chr(39))} AS replaced FROM documents")
def document_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = F.create_map(F.lit("the"), F.lit("le"), F.lit("and"), F.lit("et"))
    own = F.create_map(F.lit("and"), F.concat(F.lit("&"), (F.col("doc_id") % 3).cast("string")), F.lit("of"), F.lit("de$"))
    return table(spark, sf_dir, "documents").select("doc_id", W.document_substitutions(F.col("text"), corpus, own).alias("replaced"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(^|\\s)general[ -]public(\\s|$)', '\\1gp\\2', 'g'), '(^|\\s)version(\\s|$)', '\\1v\\2', 'g') AS replaced FROM documents WHERE contains(text, 'License')")
def expanded_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = W.expand_substitutions({"General Public": "gp", "Versions": "v"}, {"versions": "version"})
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("License"))).select("doc_id", W.substitute(pairs)(F.col("text")).alias("replaced"))


ELEMENTS = ["H2", "O", "Na", "Cl3", "Fe2", "O"]


@query(
    f"WITH e AS (SELECT {ELEMENTS} AS e), p AS (SELECT p_partkey, e[1 + p_partkey % 6] AS a, e[1 + p_size % 6] AS b, e[1 + (p_partkey + p_size) % 5] AS c FROM part, e), "
    "f AS (SELECT p_partkey, unnest([a || b || c, a || c || b, b || a || c, b || c || a, c || a || b, c || b || a]) AS form FROM p) "
    "SELECT DISTINCT p_partkey, form FROM (SELECT p_partkey, form FROM f UNION ALL SELECT p_partkey, lower(form) FROM f)"
)
def element_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three elements for each part, by its key and size, in all orders."""
    elements = F.array(*map(F.lit, ELEMENTS))
    at = lambda c: F.get(elements, c.cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    material = F.concat(at(key % 6), at(size % 6), at((key + size) % 5))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(W.element_orders(material)).alias("form"))


@query("WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '-' || (1985 + event_id % 40) WHEN 1 THEN (1985 + event_id % 40) || '-' WHEN 2 THEN '1' || event_id WHEN 3 THEN '1850' ELSE (1985 + event_id % 40)::VARCHAR END AS given FROM events) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'before' WHEN event_id % 5 = 1 THEN 'after' WHEN event_id % 5 = 4 THEN 'is' WHEN event_id % 5 = 2 AND length(given) = 4 AND given::INT > 1900 THEN 'is' END AS kind, CASE WHEN event_id % 5 IN (0, 1, 4) THEN 1985 + event_id % 40 WHEN event_id % 5 = 2 AND length(given) = 4 AND given::INT > 1900 THEN given::INT END AS year FROM e")
def year_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (1985 + F.col("event_id") % 40).cast("string")
    kind = F.col("event_id") % 5
    given = F.when(kind == 0, F.concat(F.lit("-"), year)).when(kind == 1, F.concat(year, F.lit("-"))).when(kind == 2, F.concat(F.lit("1"), F.col("event_id").cast("string"))).when(kind == 3, F.lit("1850")).otherwise(year)
    rows = table(spark, sf_dir, "events").select("event_id", rules.year_range(given, 2030).alias("x"))
    return rows.select("event_id", "x.kind", F.col("x.year").cast("long").alias("year"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN '0' ELSE 'i' || s_nationkey END AS affiliation_id, 'O''Neil Institute ' || s_nationkey AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'C' || s_nationkey END AS country, 2 AS n_authors FROM supplier")
def affiliation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affiliations written as Python literals, as mappings or as lists."""
    nation, text_ = F.col("s_nationkey").cast("string"), F.lit
    country = F.when(F.col("s_suppkey") % 3 > 0, F.concat(text_("'C"), nation, text_("'"))).otherwise(text_("None"))
    record = F.concat(text_("{'name': \"O'Neil Institute "), nation, text_("\", 'country': "), country, text_(", 'authors': ['a1', 'a2']}"))
    mapping = F.concat(text_("{'Unknown': ['a9', 'a8'], 'i"), nation, text_("': "), record, text_("}"))
    given = F.when(F.col("s_suppkey") % 4 == 3, F.concat(text_("["), record, text_("]"))).otherwise(mapping)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(rules.affiliations(given)).alias("affiliation_id", "a"))
    return rows.select("s_suppkey", "affiliation_id", "a.name", "a.country", F.size("a.authors").alias("n_authors"))


@query(
    f"WITH {POSTINGS}, n AS (SELECT count(*) AS n FROM documents), w AS (SELECT token, count(*) AS df FROM p GROUP BY ALL HAVING count(*) >= 5), s AS (SELECT doc_id, token, round(tf * (ln((1.0 + n) / (1.0 + df)) + 1.0), 9) AS raw FROM p JOIN w USING (token), n), "
    "t AS (SELECT doc_id, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, token) AS r FROM s) WHERE r <= 2), k AS (SELECT token, count(*) AS n_docs FROM t GROUP BY ALL HAVING count(*) >= 2) "
    "SELECT t.token AS term, p.token AS support, max(n_docs) AS n_docs FROM t JOIN k USING (token) JOIN p ON p.doc_id = t.doc_id JOIN w ON w.token = p.token WHERE p.token <> t.token GROUP BY t.token, p.token HAVING count(*) = max(n_docs)"
)
def term_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_rules(table(spark, sf_dir, "documents"), 2, 5, 2)
