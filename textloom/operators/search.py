"""Search over papers: indexes, filters, staged queries, word windows, rules and stores.

Papers are rows with an id, title and abstract (any may be null), year, author_ids
(``;`` between ids) and affiliations (array of id, name, country and the ids of the
authors there).  Every predicate is a Column, so several become one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lower_tokens, phrase_pattern


def items_of(c: Column) -> Column:
    """The trimmed, lower-cased items of a ``;`` list, blank ones left out; empty for null."""
    parts = F.filter(F.transform(F.split(c, ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def all_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def affiliation_values(name: str) -> Column:
    """Lower-cased values of one field of the affiliations; missing ones are empty."""
    values = F.transform(F.col("affiliations"), lambda a: F.lower(F.trim(F.coalesce(a[name].cast("string"), F.lit("")))))
    return F.coalesce(values, F.array().cast("array<string>"))


def filter_values() -> dict[str, Column]:
    """What each kind of filter compares, as arrays of strings."""
    year = F.col("year").cast("int").cast("string")
    return {
        "year": F.filter(F.array(year), lambda y: y.isNotNull()),
        "author": items_of(F.col("author_ids")),
        "affiliation": affiliation_values("id"),
        "country": affiliation_values("country"),
    }


def build_index(papers: DataFrame, id_col: str = "id") -> DataFrame:
    """kind, value, id: one row for each different value a paper has, of years, authors, affiliations, countries, title and abstract tokens."""
    values = filter_values() | {"title": lower_tokens(F.col("title")), "abstract": lower_tokens(F.col("abstract"))}
    pairs = F.flatten(F.array(*(_named(kind, v) for kind, v in values.items())))
    return papers.select(F.col(id_col).alias("id"), F.explode(pairs).alias("x")).select("x.kind", "x.value", "id")


def _named(kind: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def save_index(index: DataFrame, path: str) -> None:
    """Kinds become folders, ranges of values (and of the ids of a common value) files in order of value.

    A lookup so reads the folders of its kinds, and of their files the row groups whose span
    of values holds one it asks for.
    """
    index.repartitionByRange("kind", "value", "id").sortWithinPartitions("kind", "value", "id").write.partitionBy("kind").parquet(path)


def saved_index(spark: SparkSession, path: str) -> DataFrame:
    """The index that ``save_index`` wrote (kind, value, id)."""
    return spark.read.parquet(path).select(F.col("kind").cast("string").alias("kind"), "value", "id")


def look_up(index: DataFrame, queries=None, filters: dict[str, list] | None = None, match_all: bool = False, linked: bool = False) -> DataFrame:
    """id of the papers that ``search`` selects (without a window), from the rows of an index alone.

    Only rows of values that are asked for are read; each paper's become one row of flags.
    """
    parsed, flags = read_queries(queries), {}
    wanted = {kind: [str(v).strip().lower() for v in values] for kind, values in (filters or {}).items()}

    def has(kind: str, value: str) -> Column:
        return F.col(flags.setdefault((kind, value), f"_has{len(flags)}"))

    def hit(q: Query, dependents: bool = True) -> Column:
        held = {kind: [has(kind, w) for w in q.words] for kind in ("title", "abstract")}
        passed = {kind: all_of([has(kind, w) for w in q.positives]) & ~any_of([has(kind, w) for w in q.negatives]) if dependents else F.lit(True) for kind in held}
        return ((all_of(held["title"]) & passed["title"]) | all_of(held["abstract"])) & passed["abstract"]

    own, raw = [hit(q) for q in parsed], [hit(q, False) for q in parsed] if linked else []
    hits = [h | (r & any_of(o for j, o in enumerate(own) if j != i)) for i, (h, r) in enumerate(zip(own, raw, strict=True))] if linked else own
    test = all_of(any_of([has(kind, v) for v in values]) for kind, values in wanted.items())
    if hits:
        test = test & (all_of(hits) if match_all else any_of(hits))
    if not flags:
        return index.select("id").where(F.lit(False))
    by_kind = {kind: [v for k, v in flags if k == kind] for kind, _ in flags}
    rows = index.where(any_of((F.col("kind") == kind) & F.col("value").isin(values) for kind, values in by_kind.items()))
    told = rows.groupBy("id").agg(*(F.max((F.col("kind") == k) & (F.col("value") == v)).alias(name) for (k, v), name in flags.items()))
    return told.where(test).select("id")


def search_saved(index: DataFrame, papers: DataFrame, queries=None, filters: dict[str, list] | None = None, match_all: bool = False, window: int | None = None, ordered: bool = True, linked: bool = False, id_col: str = "id") -> DataFrame:
    """As ``search``, but the papers come from an index; where a window is asked for, their texts alone are looked at."""
    ids = look_up(index, queries, filters, match_all, linked).withColumnRenamed("id", id_col)
    found = papers.join(ids, id_col, "left_semi")
    return search(found, queries, filters, match_all, window, ordered, linked) if window else found


def value_filter(filters: dict[str, list]) -> Column:
    """One of the values of each kind."""
    of = filter_values()
    return all_of(F.arrays_overlap(of[kind], F.array(*(F.lit(str(v).strip().lower()) for v in values))) if values else F.lit(False) for kind, values in filters.items())


@dataclass
class Query:
    """Words that a text has, with words it has as well (positives) or has not (negatives)."""

    words: list[str]
    positives: list[str] = field(default_factory=list)
    negatives: list[str] = field(default_factory=list)

    @property
    def label(self) -> str:
        return " ".join([*self.words, *(f"+{w}" for w in self.positives), *(f"-{w}" for w in self.negatives)])


def read_queries(given) -> list[Query]:
    """Queries from a string, a list of strings, or strings with dependents ({"a b": ["+with", "without"]}).

    Words are lower-cased.  Dependents are single words; ``+`` marks those that are wanted.
    """
    if given is None:
        return []
    if isinstance(given, str):
        given = [given]
    if isinstance(given, dict):
        given = [given]
    if not isinstance(given, (list, tuple)):
        raise TypeError("a query is a string, a list, or a mapping of strings to dependents")
    out = []
    for one in given:
        for text, dependents in one.items() if isinstance(one, dict) else [(one, [])]:
            if not isinstance(text, str) or not text.split():
                raise ValueError(f"not a query: {text!r}")
            own = Query(text.lower().split())
            for d in [dependents] if isinstance(dependents, str) else dependents:
                word = d.removeprefix("+").lower()
                if len(word.split()) != 1:
                    raise ValueError(f"a dependent is one word: {d!r}")
                (own.positives if d.startswith("+") else own.negatives).append(word.strip())
            out.append(own)
    return out


def has_words(tokens: Column, words: list[str]) -> Column:
    return all_of(F.array_contains(tokens, w) for w in words)


def in_window(tokens: Column, words: list[str], window: int, ordered: bool = True) -> Column:
    """Does some run of ``window`` tokens hold the words, in order or not?

    Of a run the tokens that are query words are kept, each as often as the query has it
    (the first ones); these must be the query.
    """
    query = F.array(*map(F.lit, words))
    times = lambda list_, x: F.size(F.filter(list_, lambda y: y == x))
    # A run may as well begin at a query word, or be the last one.
    known = lambda own: F.filter(F.transform(own, lambda t, i: F.when(t.isin(words), F.struct(i.alias("pos"), t.alias("word")))), lambda x: x.isNotNull())

    def same(items: Column) -> Column:
        none = F.array().cast("array<string>")
        kept = F.aggregate(items, none, lambda acc, x: F.when(times(acc, x["word"]) < times(query, x["word"]), F.array_append(acc, x["word"])).otherwise(acc))
        return kept == query if ordered else F.array_sort(kept) == F.array_sort(query)

    def found(own: Column) -> Column:
        at, last = own["at"], own["last"]

        def run_from(k: Column) -> Column:
            start = F.get(at, k)["pos"]
            return (start <= last) & same(F.filter(F.slice(at, k + 1, window), lambda x: x["pos"] < start + window))

        places = F.when(F.size(at) > 0, F.sequence(F.lit(0), F.size(at) - 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(places, run_from) | same(F.filter(at, lambda x: x["pos"] >= last))

    placed = once(tokens, lambda own: F.struct(known(own).alias("at"), F.greatest(F.size(own) - window, F.lit(0)).alias("last")))
    return F.when(has_words(tokens, words), once(placed, found)).otherwise(False)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def query_hit(q: Query, window: int | None = None, ordered: bool = True, dependents: bool = True) -> Column:
    """Title matches pass the dependents of the title; then title and abstract matches pass those of the abstract.

    With ``window`` the words stand in a window of the title or of the abstract.
    """
    title, abstract = lower_tokens(F.col("title")), lower_tokens(F.col("abstract"))
    t, a = has_words(title, q.words), has_words(abstract, q.words)
    if dependents:
        t = t & has_words(title, q.positives) & ~any_of(F.array_contains(title, w) for w in q.negatives)
    hit = t | a
    if dependents:
        hit = hit & has_words(abstract, q.positives) & ~any_of(F.array_contains(abstract, w) for w in q.negatives)
    if window and len(q.words) > 1:
        hit = hit & (in_window(title, q.words, window, ordered) | in_window(abstract, q.words, window, ordered))
    return hit


def search(papers: DataFrame, queries=None, filters: dict[str, list] | None = None, match_all: bool = False, window: int | None = None, ordered: bool = True, linked: bool = False) -> DataFrame:
    """Papers that pass all filters and any (``match_all``: every) query; none without either.

    linked: a paper that another query selects comes back to a query whose words it has,
    whatever its dependents say.
    """
    parsed = read_queries(queries)
    if not parsed and not filters:
        return papers.where(F.lit(False))
    out = papers.where(value_filter(filters)) if filters else papers
    if not parsed:
        return out
    hits = query_hits(parsed, window, ordered, linked)
    return out.where(all_of(hits) if match_all else any_of(hits))


def query_hits(parsed: list[Query], window: int | None = None, ordered: bool = True, linked: bool = False) -> list[Column]:
    own = [query_hit(q, window, ordered) for q in parsed]
    if not linked:
        return own
    raw = [query_hit(q, window, ordered, dependents=False) for q in parsed]
    return [h | (r & any_of(o for j, o in enumerate(own) if j != i)) for i, (h, r) in enumerate(zip(own, raw, strict=True))]


def explain(papers: DataFrame, queries=None, filters: dict[str, list] | None = None, id_col: str = "id") -> DataFrame:
    """filter_type, filter_value, num_papers, first_id, last_id: a row for each query and filter value, also those without papers."""
    parsed, of = read_queries(queries), filter_values()
    kinds = [("query", q.label, query_hit(q)) for q in parsed]
    kinds += [(kind, str(v), F.array_contains(of[kind], str(v).strip().lower())) for kind, values in (filters or {}).items() for v in values]
    hits = papers.select(F.col(id_col).alias("id"), *(hit.alias(f"h{i}") for i, (*_, hit) in enumerate(kinds)))
    own = lambda i: F.when(F.col(f"h{i}"), F.col("id"))
    found = hits.agg(*(F.struct(F.count(own(i)).alias("n"), F.min(own(i)).alias("a"), F.max(own(i)).alias("z")).alias(f"h{i}") for i in range(len(kinds))))
    rows = F.array(*(F.struct(F.lit(kind).alias("filter_type"), F.lit(value).alias("filter_value"), F.col(f"h{i}.n").alias("num_papers"), F.col(f"h{i}.a").alias("first_id"), F.col(f"h{i}.z").alias("last_id")) for i, (kind, value, _) in enumerate(kinds)))
    return found.select(F.inline(rows))


def filter_by_searches(papers: DataFrame, searches: dict[str, Column]) -> DataFrame:
    """Papers that any search selects, each once, with the name of the last one that does (``search``)."""
    last = F.coalesce(*(F.when(hit, F.lit(name)) for name, hit in reversed(searches.items())))
    return papers.withColumn("search", last).where(F.col("search").isNotNull())


def rule_report(rows: DataFrame, rules: dict[str, dict[str, list[str]]], positives: list[str] = (), negatives: list[str] = (), match_all: bool = False, text_col: str = "text") -> DataFrame:
    """``rows`` with passed, rule (the first that fits), matched_positives and matched_negatives (of that rule, ``|`` between).

    A row passes if no global negative stands in its text, the global positives do (any, or
    all with ``match_all``), and some rule fits: its main phrase stands there, its positives
    (any or all) too, and none of its negatives.
    """
    has = lambda p: F.coalesce(F.col(text_col).rlike(phrase_pattern(p)), F.lit(False))
    some = lambda phrases: (all_of if match_all else any_of)(map(has, phrases)) if phrases else F.lit(True)
    fits = {main: has(main) & some(parts.get("positives")) & ~any_of(map(has, parts.get("negatives", ()))) for main, parts in rules.items()}
    rule = F.coalesce(*(F.when(hit, F.lit(main)) for main, hit in fits.items())) if fits else F.lit(None).cast("string")
    matched = lambda part: F.array_join(reduce(lambda acc, r: F.when(F.col("rule") == r[0], F.filter(F.array(*(F.when(has(p), F.lit(p)) for p in r[1].get(part, ()))), lambda x: x.isNotNull()) if r[1].get(part) else F.array().cast("array<string>")).otherwise(acc), rules.items(), F.array().cast("array<string>")), "|")
    out = rows.withColumn("rule", rule)
    passed = F.col("rule").isNotNull() & some(positives) & ~any_of(map(has, negatives))
    return out.withColumn("passed", passed).withColumn("matched_positives", matched("positives")).withColumn("matched_negatives", matched("negatives"))


def count_between(column: str, low: int, high: int | None = None) -> Column:
    """Number of items of a ``;`` list; null has none."""
    n = F.size(items_of(F.col(column)))
    return (n >= low) if high is None else n.between(low, high)


def has_id(column: str, ids: Iterable[str]) -> Column:
    """Some whole item of a ``;`` list is among ``ids``."""
    return F.arrays_overlap(items_of(F.col(column)), F.array(*(F.lit(i.strip().lower()) for i in ids)))


def at_affiliation(country: str | None = None, ids: Iterable[str] | None = None, name: str | None = None) -> Column:
    """Some one affiliation whose country (and name) contains the given text and whose id is among ``ids``."""
    wanted = None if ids is None else [str(i) for i in ids]

    def fits(a: Column) -> Column:
        tests = [F.lit(True)]
        if country is not None:
            tests.append(F.contains(F.lower(F.coalesce(a["country"], F.lit(""))), F.lit(country.lower())))
        if name is not None:
            tests.append(F.contains(F.lower(F.coalesce(a["name"], F.lit(""))), F.lit(name.lower())))
        if wanted is not None:
            tests.append(a["id"].cast("string").isin(wanted))
        return all_of(tests)

    return F.coalesce(F.exists(F.col("affiliations"), fits), F.lit(False))


def members(columns: dict[str, list]) -> Column:
    """Each column has one of its values."""
    return all_of(F.col(c).isin(list(values)) for c, values in columns.items())


def year_test(text: str) -> Column:
    """``2020``, ``-2020`` (before) or ``2020-`` (after), both ends included."""
    year = F.col("year").cast("int")
    digits = text.strip("-")
    if not digits.isdigit() or len(digits) != 4 or text.count("-") > 1:
        raise ValueError(f"not a year: {text!r}")
    return year <= int(digits) if text.startswith("-") else year >= int(digits) if text.endswith("-") else year == int(digits)


def keyword(word: str, columns: Iterable[str] = ("title", "abstract")) -> Column:
    """The word stands whole in some column, in either case."""
    return any_of(F.coalesce(F.col(c).rlike(rf"(?iU)\b\Q{word}\E\b"), F.lit(False)) for c in columns)


def with_authors_of(papers: DataFrame, hit: Column, affiliation: Callable[[Column], Column]) -> DataFrame:
    """Papers that ``hit`` selects, and all papers of the authors who are at an affiliation that fits there."""
    at = F.filter(F.col("affiliations"), affiliation)
    authors = papers.where(hit).select(F.explode(F.flatten(F.transform(at, lambda a: a["authors"]))).alias("author")).distinct()
    own = papers.select("id", F.explode(items_of(F.col("author_ids"))).alias("author")).join(authors, "author", "left_semi").select("id")
    return papers.join(own.unionByName(papers.where(hit).select("id")).distinct(), "id", "left_semi")


def combined(tree, leaves: dict[str, Column]) -> Column:
    """A Column of a tree of ("and", …), ("or", …), ("not", x) and names of leaves."""
    if isinstance(tree, str):
        return leaves[tree]
    word, *parts = tree
    parts = [combined(p, leaves) for p in parts]
    return ~parts[0] if word == "not" else all_of(parts) if word == "and" else any_of(parts)


def text_search(attributes: dict[str, list[str]], match_all: bool = False) -> Column:
    """Terms are patterns in either case; of one attribute any (or all) match, of several attributes one does."""
    of = lambda c, terms: (all_of if match_all else any_of)(F.coalesce(F.col(c).rlike(f"(?is){t}"), F.lit(False)) for t in terms)
    return any_of(of(c, terms) for c, terms in attributes.items())


def id_search(ids: Iterable[str]) -> Column:
    """Ids with the prefix of their column, as ``doi:10.1/x``; those of ``doi`` in lower case."""
    by: dict[str, list[str]] = {}
    for given in ids:
        kind, colon, value = given.partition(":")
        if not colon:
            raise ValueError(f"an id has a prefix: {given!r}")
        by.setdefault(kind, []).append(value.lower() if kind == "doi" else value)
    return any_of((F.lower(F.col(k)) if k == "doi" else F.col(k).cast("string")).isin(v) for k, v in by.items())


def cited_by(papers: DataFrame, references: DataFrame, targets: DataFrame) -> DataFrame:
    """Papers that some target (column id) cites; references: paper, cited."""
    cited = references.join(targets.select(F.col("id").alias("paper")), "paper", "left_semi").select(F.col("cited").alias("id"))
    return papers.join(cited, "id", "left_semi")


def sharing_authors(authorship: DataFrame, targets: DataFrame) -> DataFrame:
    """paper, shared: papers with authors of the targets (column paper) and how many; authorship: paper, author."""
    own = authorship.select("paper", "author").distinct()
    who = own.join(targets.select("paper"), "paper", "left_semi").select("author").distinct()
    return own.join(who, "author", "left_semi").groupBy("paper").agg(F.count("*").alias("shared"))


def add_tag(c: Column, tag: str) -> Column:
    return F.array_union(F.coalesce(c, F.array().cast("array<string>")), F.array(F.lit(tag)))


def remove_tag(c: Column, tag: str) -> Column:
    return F.array_remove(c, tag)


def replace_tag(c: Column, old: str, new: str) -> Column:
    return F.when(F.array_contains(c, old), add_tag(remove_tag(c, old), new)).otherwise(c)


def bloom(ids: DataFrame, column: str, bits: int, hashes: int = 3) -> DataFrame:
    """word, mask: a Bloom filter of ``bits`` bits, 64 to a row."""
    place = _places(column, bits, hashes)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    return ids.select(F.explode(place).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("mask"))


def _places(column: str, bits: int, hashes: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(bits)) for k in range(hashes)))


def may_be_in(rows: DataFrame, column: str, filter_rows: DataFrame, bits: int, hashes: int = 3) -> DataFrame:
    """``rows`` and ``maybe``: false only for values the filter was not built from.

    The filter has bits / 64 rows; Spark broadcasts it if that is small.
    """
    keyed = rows.withColumn("_places", _places(column, bits, hashes))
    for k in range(hashes):
        own = filter_rows.select(F.col("word").alias(f"_word{k}"), F.col("mask").alias(f"_mask{k}"))
        keyed = keyed.withColumn(f"_word{k}", F.shiftright(F.col("_places")[k], 6)).join(own, f"_word{k}", "left")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_places")[k] % 64).cast("int"))
    hit = all_of(F.coalesce(F.col(f"_mask{k}").bitwiseAND(bit(k)) != 0, F.lit(False)) for k in range(hashes))
    return keyed.withColumn("maybe", hit).drop("_places", *(f"_word{k}" for k in range(hashes)), *(f"_mask{k}" for k in range(hashes)))
