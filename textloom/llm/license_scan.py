"""Licence notices in documents: phrases, and an exact containment join with templates.

A text block is a window of words: for a template of L words, windows of 2 * span
words that start every span words, span being 1.25 L rounded up.  So each run of span
words lies whole in a block, however a notice is wrapped over lines, indented or
written behind comment marks (these are no words).  A block meets a template if it has
at least ``threshold`` of the template's distinct words.  The words of a template with
fewer than ``SHORT`` distinct ones also stand in any talk of licences; of the blocks that
the join finds for it only those count where its words stand one behind the other.
The join finds every block that meets a template:

* words are put in one global order, rarest in the corpus first;
* a document with a block that meets a template shares a word with the template's
  prefix - its |T| - required + 1 rarest words - so documents are joined to templates
  on these alone;
* documents with fewer known words than required are left out (length filter);
* a first shared word at place i of the template and j of the document leaves
  min(|T| - i, |D| - j) words to share at most (positional filter);
* the words in common are then counted in each block of what is left.

Phrases (``mit license`` and so on) are looked for in the words of the whole text.

All of it is DataFrame expressions.  Templates are parameters; their words, a few
hundred, are literals of the plan.  Null texts are empty; empty texts have no labels.
Rows are kept as they come; rows that share a doc_id share the labels of any of them,
and rows without doc_id have base labels only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_Z, ids_and_texts

#: Phrases, their labels, and the opening words of well-known notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
THRESHOLD = 0.8
#: Words of a run in which a template is looked for, to the template's own.
SLACK = 1.25
#: Distinct words under which a template counts only where its words stand one behind the other.
SHORT = 15
#: What stands between words, in texts of either case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, BETWEEN), lambda w: w != "")


def lowered(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, A_Z, A_Z.lower()))


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def template_sets(templates) -> list[tuple[str, list[str]]]:
    return [(label, list(dict.fromkeys(text.split()))) for label, text in templates]


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each of the templates' words stands (at most one row a word)."""
    found = docs.select(F.explode(F.array_intersect(F.split(F.lower("text"), BETWEEN), strings(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def span_of(text: str) -> int:
    return ceil(SLACK * len(text.split()))


def phrase_of(text: str) -> str | None:
    """The words of a short template, which have to stand one behind the other."""
    words = text.split()
    return " ".join(words) if len(set(words)) < SHORT else None


def blocks_meeting(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, block (number from 0), label, containment of every block that meets a template."""
    docs = ids_and_texts(docs)
    sets = template_sets(templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    often = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for number, ((label, words), (_, text)) in enumerate(zip(sets, templates, strict=True)):
        words = sorted(words, key=place.get)
        required = ceil(threshold * len(words) - 1e-9)
        prefix = words[: len(words) - required + 1]
        rows += [(w, number, label, i, words, prefix, required, span_of(text), phrase_of(text)) for i, w in enumerate(prefix)]
    index = docs.sparkSession.createDataFrame(rows, "word string, template int, label string, i int, words array<string>, prefix array<string>, required int, span int, phrase string")
    firsts = sorted({r[0] for r in rows})
    likely = docs.where(F.arrays_overlap(F.split(F.lower("text"), BETWEEN), strings(firsts)))
    known = F.array_intersect(strings(order), lowered(F.split("text", BETWEEN)))  # in the global order
    known = likely.select("doc_id", "text", known.alias("known")).where(F.size("known") >= min(r[6] for r in rows))
    shared = known.select("doc_id", "text", "known", F.posexplode("known").alias("j", "word")).where(F.col("word").isin(firsts))
    pairs = shared.join(F.broadcast(index), "word")
    left = F.least(F.size("words") - F.col("i"), F.size("known") - F.col("j"))
    first = F.array_intersect("prefix", "known")[0] == F.col("word")
    pairs = pairs.where(first & (F.size("known") >= F.col("required")) & (left >= F.col("required")) & (F.size(F.array_intersect("words", "known")) >= F.col("required")))
    pairs = pairs.select("doc_id", "template", "label", "words", "required", "span", "phrase", lowered(words_of(F.col("text"))).alias("own"))
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("own"), F.lit(1)) - 1) / F.col("span")).cast("int"))

    def met(block: Column) -> Column:
        in_a_row = F.contains(F.concat(F.lit(" "), F.array_join(block, " "), F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" ")))
        return F.when(F.col("phrase").isNull() | in_a_row, F.size(F.array_intersect("words", block))).otherwise(0)

    common = F.transform(starts, lambda k: met(F.slice("own", k * F.col("span") + 1, 2 * F.col("span"))))
    blocks = pairs.select("doc_id", "template", "label", "required", F.size("words").alias("n"), F.posexplode(common).alias("block", "common"))
    return blocks.where(F.col("common") >= F.col("required")).select("doc_id", "template", "block", "label", (F.col("common") / F.col("n")).alias("containment"))


def phrase_places(words: Column, phrase: str, label: str) -> Column:
    """Structs of start and label for each place where the phrase's words stand consecutively."""
    parts = phrase.split()
    n = F.size(words)
    shifted = [F.slice(words, k + 1, n).alias(f"w{k}") for k in range(len(parts))]

    def here(x: Column) -> Column:
        out = x["w0"] == parts[0]
        for k in range(1, len(parts)):
            out = out & (x[f"w{k}"] == parts[k])
        return out

    zipped = F.arrays_zip(*shifted)
    flagged = F.transform(zipped, lambda x, i: F.when(here(x), F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))))
    return F.filter(flagged, lambda x: x.isNotNull())


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    score: 1 where a phrase stands, else the largest containment of a block that meets a template, else 0.
    """
    docs = ids_and_texts(docs)
    last = "|".join(sorted({p.split()[-1] for p in phrases}))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    base = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    base = base.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("text").rlike(f"(?i){last}"), lowered(F.col("words"))).alias("words"))
    places = F.when(F.col("words").isNotNull(), F.concat(*(phrase_places(F.col("words"), p, label) for p, label in phrases.items()))).otherwise(none)
    base = base.select("doc_id", "n_words", places.alias("places"))
    base = base.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_distinct("places.label").alias("base"),
    )
    met = blocks_meeting(docs, templates, threshold).groupBy("doc_id").agg(F.collect_set("label").alias("met"), F.max("containment").alias("most"))
    out = base.join(met, "doc_id", "left")
    both = F.concat("base", F.coalesce("met", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def scan_sql() -> str:
    """The same rows in DuckDB SQL, every block compared with every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    quoted = lambda phrase: f"' {phrase} '" if phrase else "NULL"
    templates = ", ".join(f"('{label}', {words!r}, {span_of(text)}, {quoted(phrase_of(text))})" for (label, words), (_, text) in zip(template_sets(TEMPLATES), TEMPLATES, strict=True))
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {test}), lambda i: {{'s': i, 'l': '{label}'}})")
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{A_Z}', '{A_Z.lower()}') AS t FROM documents),
t AS (SELECT * FROM (VALUES {templates}) AS v(label, words, span, phrase)),
w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
b AS (SELECT doc_id, label, words, phrase, list_slice(w, k * span + 1, k * span + 2 * span) AS own FROM (SELECT doc_id, label, words, span, phrase, w, unnest(range((len(w) - 1) // span + 1)) AS k FROM w, t WHERE len(w) > 0)),
c AS (SELECT doc_id, label, CASE WHEN phrase IS NULL OR contains(' ' || array_to_string(own, ' ') || ' ', phrase) THEN len(list_intersect(words, own)) ELSE 0 END AS n, len(words) AS m FROM b),
m AS (SELECT doc_id, list(DISTINCT label) AS met, max(n / m) AS most FROM c WHERE n >= ceil({THRESHOLD} * m - 1e-9) GROUP BY doc_id),
p AS (SELECT doc_id, len(w) AS n_words, list_concat({", ".join(places)}) AS p FROM w)
SELECT doc_id, n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.s)) AS first_word, list_max(list_transform(p, lambda x: x.s)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.l), coalesce(met, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM p LEFT JOIN m USING (doc_id)"""
