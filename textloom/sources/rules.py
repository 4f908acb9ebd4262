"""Term rules from Markdown: each second-level heading is a rule, with optional positives and negatives."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_rules(markdown: str) -> dict[str, dict[str, list[str]]]:
    """{term: {"positives": [...], "negatives": [...]}}; lists stand on the line of their name or as bullets below it.

    Terms and entries that differ in case only are one; the first spelling stays.
    """
    rules: dict[str, dict[str, list[str]]] = {}
    spelling: dict[str, str] = {}
    term = part = None
    for line in map(str.strip, markdown.splitlines()):
        if line.startswith("## "):
            term, part = line[3:].strip(), None
            term = spelling.setdefault(term.casefold(), term)
            rules.setdefault(term, {"positives": [], "negatives": []})
        elif term and (m := re.match(r"(?i)[-*]?\s*(positives|negatives)\s*:\s*(.*)", line)):
            part = m[1].lower()
            _extend(rules[term][part], m[2].split(","))
        elif term and part and (m := re.match(r"[-*]\s+(.+)", line)):
            _extend(rules[term][part], [m[1]])
    return rules


def _extend(entries: list[str], more: list[str]) -> None:
    have = {e.casefold() for e in entries}
    for e in map(str.strip, more):
        if e and e.casefold() not in have:
            entries.append(e)
            have.add(e.casefold())


def year_filter(text: str, latest: int) -> tuple[str, int] | None:
    """("is" | "before" | "after", year) of ``2020``, ``-2020`` or ``2020-``; None unless 1900 < year <= latest + 1."""
    m = re.fullmatch(r"(-?)(\d{4})(-?)", text.strip())
    if not m or (m[1] and m[3]) or not 1900 < int(m[2]) <= latest + 1:
        return None
    return ("before" if m[1] else "after" if m[3] else "is"), int(m[2])


def year_range(c: Column, latest: int) -> Column:
    """Struct of kind (is, before, after) and year of ``2020``, ``-2020`` or ``2020-``; null unless 1900 < year <= latest."""
    digits = F.regexp_extract(c, r"^-?(\d{4})-?$", 1)
    year = F.when((digits != "") & F.length(c).between(4, 5), digits.cast("int"))
    kind = F.when(F.startswith(c, F.lit("-")), "before").when(F.endswith(c, F.lit("-")), "after").otherwise("is")
    ok = (year > 1900) & (year <= latest)
    return F.struct(F.when(ok, kind).alias("kind"), F.when(ok, year).alias("year"))


def affiliations(c: Column) -> Column:
    """Map of id to name, country and authors, of affiliations written as a Python mapping or list; entries ``Unknown`` go, lists are keyed by place."""
    record = "struct<name:string,country:string,authors:array<string>>"
    plain = F.regexp_replace(c, r"['\"]Unknown['\"]\s*:\s*\[[^\]]*\]\s*,?\s*", "")
    plain = F.regexp_replace(plain, r"(?<=[:\[,] ?)None\b", "null")
    listed = F.from_json(plain, f"array<{record}>", {"allowSingleQuotes": "true"})
    keyed = F.map_from_entries(F.transform(listed, lambda a, i: F.struct(i.cast("string"), a)))
    return F.when(F.startswith(F.trim(plain), F.lit("[")), keyed).otherwise(F.from_json(plain, f"map<string,{record}>", {"allowSingleQuotes": "true"}))
