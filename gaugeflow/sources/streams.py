"""File-based streams of JSON messages: live reads, bounded replay, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def subject(kind: str, station: str, sensor: int | None = None) -> str:
    """Display name of a message's stream."""
    return ".".join(["telemetry", kind, station, *([str(sensor)] if sensor is not None else [])])


def read_stream(spark: SparkSession, path: str, kind: str, max_files: int | None = None) -> DataFrame:
    """Decoded messages (m, ok, value) of a folder as they arrive; the checkpoint of the query that reads it is the
    acknowledgement of what is done."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return schemas.decode(reader.load(path), kind)


def replay(spark: SparkSession, path: str, kind: str, start_ms: int | None = None, end_ms: int | None = None, ts: str = "timestamp") -> DataFrame:
    """Valid messages of a folder between two times, both included."""
    good, _ = schemas.split(schemas.decode(spark.read.text(path), kind))
    if start_ms is not None:
        good = good.where(F.col(ts) >= start_ms)
    return good if end_ms is None else good.where(F.col(ts) <= end_ms)


def publish(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON texts."""
    schemas.encode(rows).write.mode("append").text(path)


def matching(rows: DataFrame, station: str | None = None, sensor: int | None = None) -> DataFrame:
    """Wildcard subscription: every station or sensor that isn't named."""
    if station is not None:
        rows = rows.where(F.col("station") == station)
    return rows if sensor is None else rows.where(F.col("sensor") == sensor)
