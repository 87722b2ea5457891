"""What a view shows of what a user asked for, as rows: the choice is a table, and so is what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How many of the asked values a kind of view takes, and from how many on it doesn't fall back to its default.
VIEWS = {"single": {"most": 1, "least": 1, "default": 1}, "several": {"most": None, "least": 1, "default": 1}, "comparison": {"most": None, "least": 2, "default": None}}


def resolved(asked: DataFrame, existing: DataFrame, value: str, view: str) -> DataFrame:
    """The values a view shows. asked: value, place (order of asking); existing: value, place (order of listing); both of
    few rows. Those asked for that exist, in the order of asking; if they are fewer than the view needs, its default: the
    first existing value, or all of them for a comparison. Repeated and null values count once and never."""
    kind = VIEWS[view]
    once = lambda df: df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min("place").alias("place"))
    listed = once(existing)
    known = once(asked).join(listed.select(value), value, "left_semi")
    both = known.withColumn("own", F.lit(True)).unionByName(listed.withColumn("own", F.lit(False)))
    n = F.count_if("own").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("own").orderBy("place", value))
    ranked = both.select(value, "place", "own", n.alias("n"), rank.alias("rank"))
    enough = F.col("n") >= kind["least"]
    within = lambda most: F.lit(True) if most is None else F.col("rank") <= most
    shown = F.when(enough, F.col("own") & within(kind["most"])).otherwise(~F.col("own") & within(kind["default"]))
    return ranked.where(shown).select(value, F.col("rank").cast("long").alias("place"))


def series_of(existing: DataFrame, stations: DataFrame, sensors: DataFrame) -> DataFrame:
    """Existing (station, sensor) rows whose station and sensor are both chosen."""
    return existing.join(F.broadcast(stations.select("station")), "station", "left_semi").join(F.broadcast(sensors.select("sensor")), "sensor", "left_semi").select(existing.columns)


def kpi_text(kpis: DataFrame) -> DataFrame:
    """mase, coverage, active and latency_ms_p50 as a tile shows them; a dash where there is none."""
    shown = lambda c, pattern, scale=1: F.coalesce(F.format_string(pattern, F.when(F.col(c).isNotNull(), F.col(c) * scale)), F.lit("–"))
    text = {"mase": shown("mase", "%.2f"), "coverage": shown("coverage", "%.1f%%", 100), "latency_ms_p50": shown("latency_ms_p50", "%.0f ms")}
    return kpis.select(*[F.when(F.col(c).isNull(), "–").otherwise(t).alias(c) for c, t in text.items()], F.col("active").cast("string").alias("active"))
