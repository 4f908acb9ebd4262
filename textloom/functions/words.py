"""Acronyms, substitutions and stems as Columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings with what stands in their place, longest first.
ENDINGS = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ousness", "ous"), ("sses", "ss"), ("ies", "y"), ("ing", ""), ("ed", ""), ("ly", ""), ("s", "")]


def _characters(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 character at each place as a number, and the place behind it; -1 where a word has ended."""
    byte = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64)
    lead = byte(0)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead
    for k in range(1, 4):
        code = np.where(size > k, code << 8 | byte(k), code)
    return np.where(at < end, code, -1), at + size


def _acronyms_in(lists: pa.ListArray, shortest: int, longest: int) -> list[list[tuple[str, str]]]:
    found: list[dict[tuple[str, str], None]] = [{} for _ in range(len(lists))]  # a dict keeps the order and each pair once
    bounds, words = lists.offsets.to_numpy().astype(np.int64), lists.values
    if not len(words) or not words.get_total_buffer_size():
        return [[] for _ in found]
    words = words.cast(pa.large_string())
    places = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    n_chars = pc.fill_null(pc.utf8_length(words), 0).to_numpy()
    firsts = _characters(data, places[:-1], places[1:])[0]
    row = np.repeat(np.arange(len(lists)), np.diff(bounds))
    low, high = bounds[0], bounds[-1]
    for n in range(shortest - 1, longest):
        own = low + np.flatnonzero(n_chars[low:high] == n)
        for shift in (1, -n):
            first = bounds[row[own - low]] if shift < 0 else own + 1
            last = bounds[row[own - low] + 1]
            at = own[(own + shift >= first) & (own + shift + n <= last)]
            place = places[at]
            for k in range(n):
                code, behind = _characters(data, place, places[at + 1])
                same = code == firsts[at + shift + k]
                at, place = at[same], behind[same]
            for i in at.tolist():
                found[row[i - low]][words[i].as_py(), " ".join(words[i + shift : i + shift + n].to_pylist())] = None
    return [list(x) for x in found]


def acronyms(words: Column, shortest: int = 3, longest: int = 8) -> Column:
    """Structs (acronym, expansion) for each run of words whose initials are the word before or after it.

    Words are lower case; a run has shortest - 1 to longest - 1 words.  Different pairs, those
    of fewer words first, then those before their run, then in order of place.  A word stands for
    as many words as it has characters, so a place has two runs at most; all places of an
    Arrow batch are compared at once, character by character.
    """

    @F.arrow_udf("array<struct<acronym:string,expansion:string>>")
    def run(lists: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("acronym", pa.string()), ("expansion", pa.string())]))
        return pa.array([[dict(zip(("acronym", "expansion"), x, strict=True)) for x in pairs] for pairs in _acronyms_in(lists, shortest, longest)], kind)

    return run(words)


def check_substitutions(pairs: dict[str, str]) -> None:
    """A term must not be both replaced and a replacement, unless it stands for itself."""
    both = sorted({k for k, v in pairs.items() if k != v} & {v for k, v in pairs.items() if k != v})
    if both:
        raise ValueError(f"replaced and a replacement: {', '.join(both)}")


def substitute(pairs: dict[str, str]):
    """A cleaning step: whole words or phrases replaced, those of most words first; a term that stands for itself is left as it is."""
    check_substitutions(pairs)
    order = sorted((k for k in pairs if k != pairs[k]), key=lambda k: (-len(k.split()), -len(k), k))
    plain = lambda v: v.replace("\\", "\\\\").replace("$", "\\$")
    return lambda c: reduce(lambda x, k: F.regexp_replace(x, rf"(?<!\S)\Q{k}\E(?!\S)", plain(pairs[k])), order, c)


def expand_substitutions(pairs: dict[str, str], lemmas: dict[str, str] | None = None) -> dict[str, str]:
    """The pairs with their keys in lower case, lemmatized, and with hyphens and spaces exchanged; keys that clash raise."""
    out: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if out.setdefault(key, value) != value:
            raise ValueError(f"{key!r} would be both {out[key]!r} and {value!r}")

    for key, value in pairs.items():
        low = key.lower()
        lemma = " ".join((lemmas or {}).get(w, w) for w in low.split())
        for form in dict.fromkeys([low, lemma]):
            for variant in dict.fromkeys([form, form.replace("-", " "), form.replace(" ", "-")]):
                put(variant, value)
    return out


def document_substitutions(text: Column, corpus: Column, own: Column, own_first: bool = True) -> Column:
    """Whole words replaced in the order of a map for all documents and then one of the document's own.

    Where both have a term the document's replacement holds, or the other without ``own_first``.
    """
    none = F.create_map().cast("map<string,string>")
    first, second = (F.coalesce(m, none) for m in ((corpus, own) if own_first else (own, corpus)))
    entries = F.concat(
        F.transform(F.map_entries(first), lambda e: F.struct(e["key"].alias("key"), F.coalesce(second[e["key"]], e["value"]).alias("value"))),
        F.filter(F.transform(F.map_entries(second), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), lambda e: ~F.map_contains_key(first, e["key"])),
    )
    literal = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.aggregate(entries, text, lambda t, e: F.regexp_replace(t, F.concat(F.lit(r"(?U)\b\Q"), e["key"], F.lit(r"\E\b")), literal(e["value"])))


def element_orders(material: Column, lower: bool = True) -> Column:
    """Sorted array of the different forms of a chemical formula with its elements (and their numbers) in any order.

    With ``lower`` also each in lower case.  Forms grow with the factorial of the number of
    elements; equal elements do not add any.  A text without elements has the empty form.
    """

    def inserted(orders: Column, element: Column) -> Column:
        places = lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: F.concat(F.slice(p, F.lit(1), k), F.array(element), F.slice(p, k + 1, F.size(p))))
        return F.array_distinct(F.flatten(F.transform(orders, places)))

    elements = F.regexp_extract_all(material, F.lit("[A-Z][a-z]?[0-9]*"), 0)
    orders = F.aggregate(elements, F.array(F.array().cast("array<string>")), inserted)
    forms = F.transform(orders, lambda p: F.array_join(p, ""))
    return F.array_sort(F.array_distinct(F.concat(forms, F.transform(forms, F.lower)) if lower else forms))


def stem(word: Column, least: int = 3) -> Column:
    """The word with the first ending of ENDINGS that leaves ``least`` characters put right."""
    out = word
    for ending, new in reversed(ENDINGS):
        out = F.when(word.endswith(ending) & (F.length(word) - len(ending) >= least), F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(new))).otherwise(out)
    return out
