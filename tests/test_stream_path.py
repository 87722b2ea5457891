"""The whole path: message files, quarantine, windows, de-duplication, archive; an outage in between, and idle stations."""

import json

from pyspark.sql import functions as F

from gaugeflow.operators import windows
from gaugeflow.operators.archive import Archive
from gaugeflow.streaming.windows import ingest_stream, upsert_stream

STATS = "station string, sensor int, timestamp long, window_ms long, mean double, min double, max double, count long, regime int"


def messages(first, last):
    return [{"station": "AB"[i % 2], "timestamp": 100 * i, "values": [float(i % 7), float(i)], "regime": i % 3} for i in range(first, last)]


def put(path, rows, name):
    (path / f"{name}.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_messages_to_archive_across_an_outage(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    archive = Archive(spark, str(tmp_path / "archive"))

    def run():
        q = upsert_stream(ingest_stream(spark, str(src), 500, 100), archive, str(tmp_path / "ckpt"), {"availableNow": True})
        q.awaitTermination()
        assert q.exception() is None

    put(src, [*messages(0, 30), '{"station": "A", "timest', '{"station": null, "timestamp": 3, "values": [1.0]}'], "a")
    run()
    first = archive.read(spark.createDataFrame([], STATS).schema).count()
    put(src, messages(30, 60), "b")
    put(src, messages(0, 30), "c")  # a replay of what was sent before
    run()
    run()
    df = spark.createDataFrame([(m["station"], m["timestamp"], m["values"], m["regime"], m["timestamp"], m["timestamp"]) for m in messages(0, 60)], "station string, timestamp long, values array<double>, regime int, arrival long, event_id long")
    newest = df.groupBy("station").agg(F.max("timestamp").alias("m"))
    want = windows.stats(df, 500).join(newest, "station").where(F.col("timestamp") + 500 <= F.col("m") - 100)
    shape = lambda d: sorted((r["station"], r["sensor"], r["timestamp"], r["count"], round(r["mean"], 9)) for r in d.collect())
    got = shape(archive.read(spark.createDataFrame([], STATS).schema))
    assert 0 < first < len(got) and got == shape(want)
