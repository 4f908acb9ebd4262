"""From raw documents to tokens: quality rules, near duplicates, repeats, benchmark leaks, SentencePiece."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, near_copies, quality_rules, sentencepiece_codec, suffix_dedup
from textloom.llm.queries import PIECES
from textloom.shared import remove_folder, stage_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash over five-word shingles, checked and completed exactly: of each group of texts of similarity 0.8 or more the smallest doc_id stays."""
    return near_copies.one_of_each_group(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that stand in an earlier document are cut; documents stay, empty ones too."""
    return suffix_dedup.without_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, lossless (whether decoding gives the text back)."""
    return sentencepiece_codec.encode_ids(docs, PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("leaks", leaks),
    ("tokens", tokens),
]

#: Learned cutoffs, byte spans and tokens are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; tables of earlier stages are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = stage_folder(spark), None
    for name, stage in STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
