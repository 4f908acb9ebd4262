"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed  # noqa: F401

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever else ``docs`` carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, A_Z, A_Z.lower())


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; used to choose how finely work is divided."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces_for(n_bytes: int, each: int, least: int = 8) -> int:
    """How many pieces of about ``each`` bytes hold ``n_bytes``."""
    return max(least, -(-n_bytes // each))


def runs_of_rows(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        start, size = 0, 0
        for i, n in enumerate(lengths(batch.column(at))):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Returns memory that this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow with freed memory given back before and after: Spark keeps Python workers for later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return whole


def lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()
