"""Tumbling-window statistics, late data and idle stations, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import align, is_finite


def explode_channels(raw: DataFrame) -> DataFrame:
    """One row per channel: sensor is the position in values, from 0."""
    rest = [c for c in raw.columns if c != "values"]
    return raw.select(*rest, F.posexplode("values").alias("sensor", "value"))


def drop_nonfinite(values: DataFrame) -> DataFrame:
    """NaN, infinite and null values go; their event stays accepted."""
    return values.where(is_finite(F.col("value")))


def nonfinite_counts(values: DataFrame, *by: str) -> DataFrame:
    bad = ~F.coalesce(is_finite(F.col("value")), F.lit(False))
    return values.groupBy(*by).agg(F.count_if(bad).alias("dropped"), F.count_if(~bad).alias("kept"))


def tumbling(raw: DataFrame, window_ms: int) -> DataFrame:
    """station, sensor, timestamp (window start), count, mean, min, max of the finite values. Windows without one give
    no row. One shuffle, on the group, after partial aggregation on the map side."""
    rows = drop_nonfinite(explode_channels(raw.select("station", "timestamp", "values")))
    return rows.groupBy("station", "sensor", align(F.col("timestamp"), window_ms).alias("timestamp")).agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def majority(raw: DataFrame, window_ms: int) -> DataFrame:
    """station, timestamp, regime: the most frequent known regime of a station's window, the least of equals, null if
    none is known. Counted per event, so channels don't weigh it."""
    return raw.groupBy("station", align(F.col("timestamp"), window_ms).alias("timestamp")).agg(F.mode("regime", True).alias("regime"))


def stats(raw: DataFrame, window_ms: int) -> DataFrame:
    """tumbling() with window_ms and the station window's majority regime. Counts per regime ride along with the values
    of sensor rows at event grain, so both meet in a join of aggregates, never of events."""
    return tumbling(raw, window_ms).join(majority(raw, window_ms), ["station", "timestamp"]).select("station", "sensor", "timestamp", F.lit(window_ms).cast("long").alias("window_ms"), "mean", "min", "max", "count", "regime")


def running_max_before(rows: DataFrame, key: str, order: list[str], chunk: Column, value: str, out: str) -> DataFrame:
    """Adds the largest value of the key's rows before this one (null for the first).

    chunk must not fall along the order. Rows are compared within (key, chunk) only; what earlier chunks bring comes
    from one row each, so a key that holds most rows is still spread over as many tasks as it has chunks.
    """
    rows = rows.withColumn("__chunk", chunk)
    whole = rows.groupBy(key, "__chunk").agg(F.max(value).alias("__most"))
    carry = whole.withColumn("__carry", F.max("__most").over(Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("__most")
    own = F.max(value).over(Window.partitionBy(key, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__own", own).join(carry, [key, "__chunk"]).withColumn(out, F.greatest("__own", "__carry")).drop("__own", "__carry", "__chunk")


#: Arrival span of a chunk of running_max_before, in windows.
CHUNK_WINDOWS = 24


def mark_late(raw: DataFrame, window_ms: int, lateness_ms: int, arrival: str = "arrival", order: str = "event_id") -> DataFrame:
    """Adds late: whether the event's window was closed when it arrived. A station's bound is its own largest earlier
    timestamp less the lateness; a window that ends at the bound is closed. Other stations don't matter."""
    chunk = F.floor(F.col(arrival) / (window_ms * CHUNK_WINDOWS))
    rows = running_max_before(raw, "station", [arrival, order], chunk, "timestamp", "__before")
    late = align(F.col("timestamp"), window_ms) + window_ms <= F.col("__before") - lateness_ms
    return rows.withColumn("late", F.coalesce(late, F.lit(False))).drop("__before")


def mark_late_globally(raw: DataFrame, window_ms: int, lateness_ms: int, arrival: str = "arrival", order: str = "event_id") -> DataFrame:
    """The same with one bound for all stations, for contrast: what a global watermark would drop."""
    chunk = F.floor(F.col(arrival) / (window_ms * CHUNK_WINDOWS))
    rows = running_max_before(raw.withColumn("__all", F.lit(0)), "__all", [arrival, order], chunk, "timestamp", "__before").drop("__all")
    late = align(F.col("timestamp"), window_ms) + window_ms <= F.col("__before") - lateness_ms
    return rows.withColumn("late", F.coalesce(late, F.lit(False))).drop("__before")


def open_windows(raw: DataFrame, window_ms: int, lateness_ms: int) -> DataFrame:
    """station, timestamp, max_ts: windows that no later event of their station has closed yet."""
    starts = raw.groupBy("station", align(F.col("timestamp"), window_ms).alias("start")).agg(F.max("timestamp").alias("most"))
    most = raw.groupBy("station").agg(F.max("timestamp").alias("max_ts"))
    return starts.join(most, "station").where(F.col("start") + window_ms > F.col("max_ts") - lateness_ms).select("station", F.col("start").alias("timestamp"), "max_ts")


def idle_close(raw: DataFrame, window_ms: int, lateness_ms: int, idle_ms: int, now_ms: int) -> DataFrame:
    """Open windows of the stations whose newest event is more than idle_ms older than now: an idle flush closes them."""
    return open_windows(raw, window_ms, lateness_ms).where(F.lit(now_ms) - F.col("max_ts") > idle_ms)


def strictly_newer(rows: DataFrame, key: list[str], arrival: list[str], ts: str = "timestamp") -> DataFrame:
    """Rows whose timestamp is over all earlier accepted ones of their key, by arrival order."""
    before = F.max(ts).over(Window.partitionBy(*key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(ts) > F.col("__before"))).drop("__before")
