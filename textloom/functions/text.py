"""Cleaning steps and tokens as Column expressions; a chain of steps is one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters written as hyphens, and steps as (pattern, replacement).
HYPHENS = "‐‑‒–—―−⸺⸻"
PATTERNS = {
    "remove_trailing_dash": (r"(?<!\w)-|-(?!\w)", ""),
    "make_hyphens_words": (r"([a-z])\-([a-z])", ""),
    "remove_next_line": (r"\n+", " "),
    "remove_email": (r"\S*@\S*\s?", ""),
    "remove_formulas": (r"\b\w*[\=\≈\/\\\±]\w*\b", ""),
    "remove_dash": (r"-", ""),
    "remove_between_[]": (r"\[.*?\]", " "),
    "remove_between_()": (r"\(.*?\)", " "),
    "remove_[]": (r"[\[\]]", " "),
    "remove_()": (r"[()]", " "),
    "remove_\\": (r"\\", " "),
    "remove_numbers": (r"\b\d+\b", ""),
    "remove_standalone_numbers": (r"\b\d+\b", ""),
    "remove_nonASCII_boundary": (r"\b[^\x00-\x7F]+\b", ""),
    "remove_nonASCII": (r"[^\x00-\x7F]+", ""),
    "remove_tags": (r"&lt;/?.*?&gt;", ""),
    "remove_special_characters": (r"[!|\"#$%&'()*+,./:;<=>?@\[\]^_`{}~]", ""),
    "remove_extra_whitespace": (r"\s+", " "),
    "remove_alphanumeric": (r"\b(?=\w*[A-Za-z])(?=\w*\d)\w+\b", ""),
    "remove_roman_numerals": (r"(?i)\bM{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\b", ""),
}


def tokens(c: Column) -> Column:
    """Words between white space; empty for null."""
    return F.coalesce(F.filter(F.split(c, r"\s+"), lambda t: t != ""), F.array().cast("array<string>"))


def lower_tokens(c: Column) -> Column:
    return tokens(F.lower(c))


#: Classes and boundaries are those of Unicode; ``.`` stops at line feeds only.
FLAGS = "(?Ud)"
MARK = "\ue000"


def quoted_terms(terms: Iterable[str]) -> str:
    return "|".join(rf"\Q{t}\E" for t in sorted(terms, key=lambda t: (-len(t), t)))


def regex_step(pattern: str, replacement: str, frozen: Iterable[str] = ()) -> Callable[[Column], Column]:
    """A step that replaces a pattern of one's own; matches that start inside a frozen term stay."""
    frozen = sorted(set(frozen))
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    if not frozen:
        return lambda c: F.regexp_replace(c, FLAGS + pattern, literal)
    terms = f"({quoted_terms(frozen)})"

    def step(c: Column) -> Column:
        marked = F.regexp_replace(c, rf"{FLAGS}{terms}|(?:{pattern})", "$1" + MARK)
        return F.replace(F.regexp_replace(marked, terms + MARK, "$1"), F.lit(MARK), F.lit(replacement))

    return step


def pattern_step(name: str, frozen: Iterable[str] = ()) -> Callable[[Column], Column]:
    return regex_step(*PATTERNS[name], frozen)


def lower_case(frozen: Iterable[str] = ()) -> Callable[[Column], Column]:
    """Lower case; with frozen tokens, which keep theirs, white space between tokens becomes one space."""
    frozen = sorted(set(frozen))
    if not frozen:
        return F.lower
    return lambda c: F.array_join(F.transform(tokens(c), lambda t: F.when(t.isin(frozen), t).otherwise(F.lower(t))), " ")


def remove_stop_words(stop_words: Iterable[str], whole: bool = False, frozen: Iterable[str] = ()) -> Callable[[Column], Column]:
    """Keeps runs of word characters and hyphens, joined by spaces, of which no part between hyphens (``whole``: not all of it) is a stop word."""
    stop, frozen = sorted({w.lower() for w in stop_words}), sorted(set(frozen))

    def keep(t: Column) -> Column:
        bad = F.lower(t).isin(stop) if whole else F.exists(F.split(F.lower(t), "-"), lambda p: p.isin(stop))
        return ~bad | t.isin(frozen) if frozen else ~bad

    return lambda c: F.array_join(F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\b[\w-]+\b"), F.lit(0)), keep), " ")


def remove_stop_phrases(phrases: Iterable[str]) -> Callable[[Column], Column]:
    """Each phrase is a pattern, in either case."""
    return lambda c: reduce(lambda x, p: F.regexp_replace(x, f"(?i){FLAGS}{p}", ""), phrases, c)


def accents() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character and marks, and that character."""
    import sys
    import unicodedata

    found = []
    for c in map(chr, range(0xA0, sys.maxunicode + 1)):
        if not 0xAC00 <= ord(c) < 0xE000 and unicodedata.decomposition(c):
            plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(plain) == 1 and plain != c:
                found.append((c, plain))
    return "".join(c for c, _ in found), "".join(p for _, p in found)


def remove_accents(c: Column) -> Column:
    """Letters without their marks; Hangul syllables stay whole."""
    return F.regexp_replace(F.translate(c, *accents()), r"\p{Mn}+", "")


def isolate_terms(frozen: Iterable[str]) -> Callable[[Column], Column]:
    """What is not a letter and stands beside a frozen term becomes a space."""
    letter = r"[^\p{L}]"

    def step(c: Column) -> Column:
        for t in sorted(set(frozen)):
            c = F.regexp_replace(F.regexp_replace(c, rf"{letter}(?=\Q{t}\E)", " "), rf"(?<=\Q{t}\E){letter}", " ")
        return c

    return step


def lemmatize(lemmas: dict[str, str], frozen: Iterable[str] = ()) -> Callable[[Column], Column]:
    """Tokens replaced by their entry in a dictionary; spaced hyphens are closed up first."""
    table = F.create_map(*(F.lit(x) for k, v in sorted(lemmas.items()) if k not in set(frozen) for x in (k, v)))
    return lambda c: F.array_join(F.transform(tokens(F.replace(c, F.lit(" - "), F.lit("-"))), lambda t: F.coalesce(table[t], t)), " ")


def standardize_hyphens(c: Column) -> Column:
    return F.translate(c, HYPHENS, "-" * len(HYPHENS))


def drop_tokens(stop_words: Iterable[str] = (), min_characters: int = 1, numbers: bool = True) -> Callable[[Column], Column]:
    """Drops stop words, short tokens and (unless ``numbers``) tokens of digits only."""
    stop = sorted(set(stop_words))

    def keep(t: Column) -> Column:
        ok = F.length(t) >= min_characters
        if stop:
            ok = ok & ~t.isin(stop)
        return ok if numbers else ok & ~t.rlike(r"^[0-9]+$")

    return lambda c: F.array_join(F.filter(tokens(c), keep), " ")


def remove_copyright(c: Column) -> Column:
    """The longer side of the last copyright sign; behind a leading sign, what follows the first full stop."""
    sign = F.lit("©")
    at = F.length(c) - F.instr(F.reverse(c), "©") + 1
    head, tail = F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.length(c))
    dot = F.instr(c, ".")
    led = F.when(dot > 0, F.trim(F.substring(c, dot + 1, F.length(c)))).otherwise(c)
    return F.when(F.instr(c, "©") == 0, c).when(F.startswith(c, sign), led).when(F.length(head) > F.length(tail), head).otherwise(c)


def clean(c: Column, steps: Iterable[Callable[[Column], Column]]) -> Column:
    """``steps`` in order, then trimmed; empty results are null."""
    out = reduce(lambda x, step: step(x), steps, F.coalesce(c, F.lit("")))
    return F.nullif(F.trim(out), F.lit(""))


def phrase_pattern(phrase: str) -> str:
    """A phrase's words with anything but word characters between, as whole words, in either case."""
    words = [rf"\Q{w}\E" for w in phrase.split()]
    return r"(?iU)(?<!\w)" + r"\W+".join(words) + r"(?!\w)"
