"""The streaming operator gives what the batch operator gives on the same arrival order, also across a restart."""

import random

from pyspark.sql import functions as F

from gaugeflow.operators import windows
from gaugeflow.operators.archive import Archive
from gaugeflow.streaming.windows import dedup_stream, upsert_stream, window_stream

SCHEMA = "station string, timestamp long, values array<double>, regime int, seq long"


def run(spark, src, out, ckpt):
    from pyspark.errors import StreamingQueryException  # noqa: F401

    q = window_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), 500, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("AB"), 40 * i + rng.randrange(-400, 400), [rng.uniform(0, 1), float(i)], i % 3, i) for i in range(120)]
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    for part in range(2):
        spark.createDataFrame(rows[part * 60 : part * 60 + 60], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run(spark, src, out, ckpt)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("arrival", F.col("seq")).withColumn("event_id", F.col("seq"))
    kept = windows.mark_late(df, 500, 100).where(~F.col("late"))
    newest = kept.groupBy("station").agg(F.max("timestamp").alias("m"))
    want = windows.stats(kept, 500).join(newest, "station").where(F.col("timestamp") + 500 <= F.col("m") - 100)
    shape = lambda d: sorted((r["station"], r["sensor"], r["timestamp"], r["count"], round(r["mean"], 9), r["min"], r["max"], r["regime"]) for r in d.collect())
    assert shape(spark.read.parquet(out)) == shape(want) != []


def test_idempotent_sink(spark, tmp_path):
    cols = "station string, sensor int, timestamp long, window_ms long, mean double, min double, max double, count long, regime int"
    src = str(tmp_path / "stats")
    batch = spark.createDataFrame([("A", 0, i * 500, 500, 1.0, 0.0, 2.0, 5, 0) for i in range(6)], cols)
    batch.coalesce(1).write.parquet(src)
    batch.limit(4).coalesce(1).write.mode("append").parquet(src)
    a = Archive(spark, str(tmp_path / "archive"))
    q = upsert_stream(spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(src), a, str(tmp_path / "ckpt"), {"availableNow": True})
    q.awaitTermination()
    assert a.read(batch.schema).count() == 6


def test_duplicates_within_the_span(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("A", 1), ("A", 1), ("B", 2)], "id string, n int").withColumn("at", F.current_timestamp()).coalesce(1).write.parquet(src)
    s = dedup_stream(spark.readStream.schema("id string, n int, at timestamp").parquet(src), ["id"], "at")
    q = s.writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 2
