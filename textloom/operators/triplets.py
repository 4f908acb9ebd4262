"""Knowledge graphs from tables: head, relation, tail with types, weights and attributes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TRIPLES = (
    "array<array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,weight:double,"
    "head_attributes:map<string,string>,tail_attributes:map<string,string>>>>"
)


@dataclass(frozen=True)
class Relation:
    """How one relation is read off a row.

    head, tail: SQL expressions of an id, or with ``head_split`` / ``tail_split`` of a text that
    holds several ids with that separator.  Attributes are SQL expressions by name.
    """

    name: str
    head: str
    head_type: str
    tail: str
    tail_type: str
    head_split: str | None = None
    tail_split: str | None = None
    weight: str = "1"
    head_attributes: dict[str, str] = field(default_factory=dict)
    tail_attributes: dict[str, str] = field(default_factory=dict)


def _ends(sql: str, separator: str | None) -> Column:
    whole = F.expr(sql).cast("string")
    parts = F.split(whole, f"\\Q{separator}\\E") if separator else F.array(whole)
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def _attributes(given: dict[str, str]) -> Column:
    if not given:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*(c for name, sql in sorted(given.items()) for c in (F.lit(name), F.expr(sql).cast("string"))))


def _read_off(r: Relation) -> Column:
    def triple(head: Column, tail: Column) -> Column:
        values = {
            "head": head,
            "head_type": F.lit(r.head_type),
            "relation": F.lit(r.name),
            "tail": tail,
            "tail_type": F.lit(r.tail_type),
            "weight": F.expr(r.weight).cast("double"),
            "head_attributes": _attributes(r.head_attributes),
            "tail_attributes": _attributes(r.tail_attributes),
        }
        return F.struct(*(c.alias(name) for name, c in values.items()))

    return F.transform(_ends(r.head, r.head_split), lambda head: F.transform(_ends(r.tail, r.tail_split), lambda tail: triple(head, tail)))


def triplets(df: DataFrame, relations: list[Relation]) -> DataFrame:
    """head, head_type, relation, tail, tail_type, weight, head_attributes, tail_attributes of every row and relation.

    Null and blank ids make no triplet.  All relations come from one pass over ``df``.
    """
    # A null list of heads or tails would make the whole concatenation null.
    found = [F.filter(_read_off(r), lambda x: x.isNotNull()) for r in relations]
    none = F.array().cast(TRIPLES)
    return df.select(F.inline(F.flatten(F.concat(*(F.coalesce(x, none) for x in found)))))


def edges_of(triples: DataFrame) -> DataFrame:
    """One row per different triplet, weights added up."""
    return triples.groupBy("head", "head_type", "relation", "tail", "tail_type").agg(F.sum("weight").alias("weight"))


def nodes_of(triples: DataFrame) -> DataFrame:
    """id, type, attributes: one row per node; of several attribute maps the largest by its text counts."""
    ends = triples.select(
        F.inline(F.array(*(F.struct(F.col(e).alias("id"), F.col(f"{e}_type").alias("type"), F.col(f"{e}_attributes").alias("attributes")) for e in ("head", "tail"))))
    )
    return ends.groupBy("id", "type").agg(F.max_by("attributes", F.to_json("attributes")).alias("attributes"))
