"""The test tables seen as telemetry: deterministic views, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import epoch_ms
from ..operators import forecast, windows

HOUR = 3_600_000
DAY = 24 * HOUR
#: A point of time within the events' month, 2024-01-15 00:00:00.
NOW = 1_705_276_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, station, timestamp, values (value, props.k), regime."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", F.col("event_type").alias("station"), epoch_ms("ts").alias("timestamp"), F.array("value", k).alias("values"), (F.col("user_id") % 3).cast("int").alias("regime"))


def disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw with an arrival time up to two hours after the event."""
    return raw(spark, sf_dir).withColumn("arrival", F.col("timestamp") + F.col("event_id") * 7919 % 7200 * 1000)


def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw and every tenth row once more; copy tells them apart."""
    r = raw(spark, sf_dir)
    return r.withColumn("copy", F.lit(0)).unionByName(r.where(F.col("event_id") % 10 == 0).withColumn("copy", F.lit(1)))


def nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw(spark, sf_dir)
    first = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("event_id") % 101 == 0, float("inf")).otherwise(F.col("values")[0])
    return r.withColumn("values", F.array(first, F.col("values")[1]))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stats(raw(spark, sf_dir), HOUR)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stats with a time of arrival 0 to 399 ms after the window's end."""
    return stats(spark, sf_dir).withColumn("received", F.col("timestamp") + F.col("window_ms") + F.floor(F.col("timestamp") / HOUR) * 37 % 400 + F.col("sensor") * 3)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.forecasts(stats(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats(spark, sf_dir)
    return forecast.scores(forecast.forecasts(s), s)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.rolling_metrics(scored(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, timestamp, seq, truth, state: a detector that is wrong for every fifth event and names states its own way."""
    r = raw(spark, sf_dir)
    wrong = (F.col("event_id") % 5 == 0).cast("int")
    return r.select("station", "timestamp", F.col("event_id").alias("seq"), F.col("regime").alias("truth"), ((F.col("regime") + 1 + wrong) % 3).alias("state"))


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message of some kind for every event: rule, state and sensor follow from the event's number."""
    r = raw(spark, sf_dir)
    rule = F.element_at(F.array(*map(F.lit, ("anomaly", "calibration", "model_degraded", "regime_change", "regime_accuracy"))), (F.floor(F.col("event_id") / 7) % 5 + 1).cast("int"))
    stationwide = rule.isin("regime_change", "regime_accuracy")
    resolved = rule.isin("calibration", "model_degraded", "regime_accuracy") & (F.col("event_id") % 3 == 0)
    return r.select(
        F.col("event_id").alias("seq"), "station", F.when(~stationwide, F.col("event_id") % 2).cast("int").alias("sensor"), "timestamp", rule.alias("rule"),
        F.when(resolved, "resolved").otherwise("firing").alias("state"), F.when(resolved, "info").when(rule.isin("calibration"), "serious").otherwise("warning").alias("severity"),
    )
