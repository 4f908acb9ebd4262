"""Queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..shared import stage_folder
from . import chat_format, decontaminate, lexical_search, license_scan, ppm_score, quality_classifier, quality_rules, sentencepiece_codec, simhash, suffix_dedup, token_alignment, token_counts, warc
from .common import documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(documents(spark, sf_dir), PIECES)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), WORD_PIECES)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], given.schema)
    return chat_format.conversation_digests(given.unionByName(more), PIECES)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(documents(spark, sf_dir))


def op8_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score.score_documents(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_folder(spark)}/warc"
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.page_digests(spark, folder)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(documents(spark, sf_dir), BYTES, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_license_scan,
        op3_token_counts,
        op4_decontaminate,
        op5_simhash,
        op6_chat_format,
        op7_suffix_dedup,
        op8_ppm_score,
        op9_quality_rules,
        op10_quality_classifier,
        op11_warc,
        op12_lexical_search,
        op13_token_alignment,
    )
}

ORACLE: dict[str, str] = {"op2_license_scan": license_scan.scan_sql(), "op12_lexical_search": lexical_search.search_sql()}
