"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder of ``spark.checkpoint.dir``.

    Where that is unset, a session whose driver and executors are one process makes a
    temporary folder; any other takes a folder in the warehouse, which all share.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and context._jsc.sc().isLocal():
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a table beside the checkpoints and read back.

    For loops: a checkpoint keeps the size that was estimated for its plan, and as the estimate
    of a join is a product, a loop of joins makes numbers whose digits grow without end.  A
    table has the size of its files.
    """
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_loop(turn: int):
    """How to cut lineage in a turn of a loop: a checkpoint, and a table every fourth turn, which brings estimates back to size."""
    return written if turn % 4 == 3 else checkpointed


def stage_folder(spark: SparkSession) -> str:
    """A new folder's path beside the checkpoints, for tables that later stages read."""
    context = spark.sparkContext
    ensure_checkpoint_dir(spark)
    return f"{context._jsc.sc().getCheckpointDir().get()}/stages-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``stage_folder`` named, with what is in it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def remove_written(df: DataFrame) -> None:
    """Removes the table behind a DataFrame of ``written`` that nothing will read any more."""
    files = df.inputFiles()
    if files:
        remove_folder(df.sparkSession, files[0].rsplit("/", 1)[0])


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of a table, each a key and a few numbers, that are sent to every task.
MOST_BROADCAST = 500_000


def small(df: DataFrame) -> bool:
    """Has ``df`` so few rows that it may go to every task?"""
    return df.count() <= MOST_BROADCAST


def rewritten(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` written, and the table of ``written`` behind ``old``, which it was made from, removed."""
    out = written(new)
    remove_written(old)
    return out
