"""Author tables: names by id, matches of two id systems, possible duplicates, unified ids, affiliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph.components import connected_components


def name_key(name: Column) -> Column:
    """Words of a name in lower case without marks, sorted, so that "Doe, J." and "J Doe" agree."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two name keys, 0 where one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def id_names(papers: DataFrame, ids: str = "author_ids", names: str = "authors", order: str = "paper") -> DataFrame:
    """id, name: ';'-joined lists zipped by place; of an id's names that of the first paper.  Blank ids are left out."""
    pairs = papers.select(order, F.posexplode(F.arrays_zip(F.split(ids, ";").alias("id"), F.split(names, ";").alias("name"))).alias("pos", "x"))
    pairs = pairs.select(order, "pos", F.trim("x.id").alias("id"), F.trim("x.name").alias("name")).where("id != '' AND name != ''")
    return pairs.groupBy("id").agg(F.min_by("name", F.struct(order, "pos")).alias("name"))


def match_authors(left: DataFrame, right: DataFrame, least_papers: int = 1, similarity: float = 0.8) -> DataFrame:
    """left_id, right_id, papers, similarity: for each left author the right author of most shared papers with a like name.

    Both sides have rows (paper, id, name), joined by paper, so pairs are those of one paper only.
    """
    a = left.select("paper", F.col("id").alias("left_id"), name_key(F.col("name")).alias("left_name")).distinct()
    b = right.select("paper", F.col("id").alias("right_id"), name_key(F.col("name")).alias("right_name")).distinct()
    like = name_similarity(F.col("left_name"), F.col("right_name"))
    pairs = a.join(b, "paper").withColumn("similarity", like).where(F.col("similarity") >= similarity)
    counts = pairs.groupBy("left_id", "right_id").agg(F.countDistinct("paper").alias("papers"), F.max("similarity").alias("similarity")).where(F.col("papers") >= least_papers)
    best = Window.partitionBy("left_id").orderBy(F.desc("papers"), F.desc("similarity"), "right_id")
    return counts.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def possible_duplicates(authorships: DataFrame, least_shared: int = 2) -> DataFrame:
    """a, b, shared: ids of one name key with so many collaborators in common and no paper together.

    Pairs come from ids of one name key, split by collaborator: a name key that
    many ids carry yields only pairs that meet at a collaborator.
    """
    rows = authorships.select("paper", "id", name_key(F.col("name")).alias("key")).where("id IS NOT NULL AND key != ''").distinct()
    with_others = rows.join(rows.select("paper", F.col("id").alias("other")), "paper").where("id != other").select("id", "key", "other").distinct()
    pairs = with_others.select(F.col("id").alias("a"), "key", "other").join(with_others.select(F.col("id").alias("b"), "key", "other"), ["key", "other"]).where("a < b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    return counts.join(with_others.select(F.col("id").alias("a"), F.col("other").alias("b")), ["a", "b"], "left_anti")


def unified_ids(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """id, unified, name: the smallest id and the longest name (ties to the first) of each connected group; single ids stand for themselves.

    ``pairs`` has (a, b) and ``names`` (id, name), with integer ids.
    """
    groups = connected_components(pairs, "a", "b").withColumnRenamed("node", "id")
    placed = names.join(groups, "id", "left").select("id", "name", F.coalesce("component", "id").alias("unified"))
    longest = placed.groupBy("unified").agg(F.min(F.struct((-F.length(F.coalesce("name", F.lit("")))).alias("n"), F.col("name"))).alias("x"))
    return placed.drop("name").join(longest.select("unified", F.col("x.name").alias("name")), "unified").select("id", "unified", "name")


def affiliations(rows: DataFrame) -> DataFrame:
    """id, affiliation, first_seen, last_seen, papers from rows (id, affiliation, paper, year); a year of 0 or null counts for none."""
    year = F.when(F.col("year") > 0, F.col("year"))
    known = rows.where("id IS NOT NULL AND affiliation IS NOT NULL")
    return known.groupBy("id", "affiliation").agg(F.min(year).alias("first_seen"), F.max(year).alias("last_seen"), F.countDistinct("paper").alias("papers"))
