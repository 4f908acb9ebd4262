"""Token counts of a stream of documents, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_tokens


def windowed_tokens(rows: DataFrame, time_col: str, text_col: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, token, n: counts per window; rows later than the watermark are dropped by Spark.  Works on streams and tables."""
    seen = rows.withWatermark(time_col, late) if rows.isStreaming else rows
    tokens = seen.select(time_col, F.explode(lower_tokens(F.col(text_col))).alias("token"))
    counts = tokens.groupBy(F.window(time_col, width).alias("w"), "token").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "token", "n")
