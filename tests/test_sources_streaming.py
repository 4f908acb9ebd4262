from pyspark.sql import functions as F

from textloom.sources.rules import parse_rules, year_filter
from textloom.streaming.counts import windowed_tokens


def test_rules():
    text = "intro\n## Neural Net\npositives: layer, Layer, depth\nnegatives:\n- biology\n* cell\n## other\n## neural net\n- positives: train\n"
    assert parse_rules(text) == {"Neural Net": {"positives": ["layer", "depth", "train"], "negatives": ["biology", "cell"]}, "other": {"positives": [], "negatives": []}}


def test_years():
    assert [year_filter(t, 2026) for t in ("2020", "-2020", "2020-", "1900", "2028", "x")] == [("is", 2020), ("before", 2020), ("after", 2020), None, None, None]


def test_stream_equals_table(spark):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    rows.coalesce(1).write.mode("overwrite").parquet(folder)
    want = windowed_tokens(spark.read.parquet(folder), "ts", "text").collect()
    stream = windowed_tokens(spark.readStream.schema(rows.schema).parquet(folder), "ts", "text")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("tokens").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(map(tuple, spark.sql("SELECT * FROM tokens").collect())) == sorted(map(tuple, want))
