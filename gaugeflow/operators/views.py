"""View queries: cross-sections, correlations, z-scores, down-sampling, latency, health and incremental deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["station", "sensor"]


def keep_last(rows: DataFrame, key: list[str], n: int, order: str = "timestamp") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def every_nth(rows: DataFrame, key: list[str], n: int, order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") % n == 0).drop("__r")


def select_series(rows: DataFrame, stations: list[str], sensors: list[int]) -> DataFrame:
    return rows.where(F.col("station").isin(stations) & F.col("sensor").isin(sensors))


def crop(rows: DataFrame, cutoff_ms: int, ts: str = "timestamp") -> DataFrame:
    return rows.where(F.col(ts) >= cutoff_ms)


def cross_section(rows: DataFrame, by: list[str], series: list[str], value: str = "mean") -> DataFrame:
    """Mean, least and largest value over the series of a group, at the timestamps that all of them have."""
    want = rows.groupBy(*by).agg(F.count_distinct(*series).alias("__n")) if by else None
    per = rows.groupBy(*by, "timestamp").agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("__c"))
    if by:
        return per.join(want, by).where(F.col("__c") == F.col("__n")).drop("__c", "__n")
    n = rows.agg(F.count_distinct(*series).alias("__n"))
    return per.crossJoin(F.broadcast(n)).where(F.col("__c") == F.col("__n")).drop("__c", "__n")


def change_correlation(rows: DataFrame, value: str = "mean", least: int = 20, cutoff_ms: int | None = None) -> DataFrame:
    """Pearson correlation of the changes of each pair of series (a pair with itself included, in one order), taken
    between neighbouring common timestamps; null where there are too few or one side doesn't vary."""
    rows = rows if cutoff_ms is None else crop(rows, cutoff_ms)
    side = lambda n: rows.select(F.col("timestamp"), F.col("station").alias(f"station_{n}"), F.col("sensor").alias(f"sensor_{n}"), F.col(value).alias(n))
    order = F.struct(F.col("station_a").alias("s"), F.col("sensor_a").alias("c")) <= F.struct(F.col("station_b").alias("s"), F.col("sensor_b").alias("c"))
    pairs = side("a").join(side("b"), "timestamp").where(order)
    key = ["station_a", "sensor_a", "station_b", "sensor_b"]
    w = Window.partitionBy(*key).orderBy("timestamp")
    diffs = pairs.withColumn("da", F.col("a") - F.lag("a").over(w)).withColumn("db", F.col("b") - F.lag("b").over(w))
    g = diffs.groupBy(*key).agg(F.count("*").alias("n"), F.covar_pop("da", "db").alias("cov"), F.stddev_pop("da").alias("sa"), F.stddev_pop("db").alias("sb"))
    ok = (F.col("n") >= least + 1) & (F.col("sa") >= 1e-12) & (F.col("sb") >= 1e-12)
    return g.select(*key, F.col("n").alias("common"), F.when(ok, F.round(F.col("cov") / F.when(ok, F.col("sa") * F.col("sb")), 2)).alias("r"))


def zscore_params(rows: DataFrame, key: list[str], value: str = "mean") -> DataFrame:
    """Population mean and deviation; (0, 1) under two values, deviation 1 where there is none to speak of."""
    g = rows.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    few = F.col("n") < 2
    return g.select(*key, F.when(few, 0.0).otherwise(F.col("m")).alias("a"), F.when(few | (F.col("s") <= 1e-12), 1.0).otherwise(F.col("s")).alias("b"))


def compare(rows: DataFrame, key: list[str], value: str = "mean") -> DataFrame:
    return rows.join(zscore_params(rows, key, value), key).withColumn("z", (F.col(value) - F.col("a")) / F.col("b"))


def decimate(rows: DataFrame, key: list[str], most: int, agg: str, value: str = "mean") -> DataFrame:
    """At most `most` points a trace: neighbouring rows share a bucket, whose x is its last row's. Nulls don't count; a
    bucket of nulls is null. agg: mean, min, max or last."""
    n = F.count("*").over(Window.partitionBy(*key))
    r = F.row_number().over(Window.partitionBy(*key).orderBy("timestamp"))
    size = F.when(n <= most, F.lit(1)).otherwise(F.ceil(n / most))
    rows = rows.withColumn("__b", F.floor((r - 1) / size))
    y = {"mean": F.avg(value), "min": F.min(value), "max": F.max(value), "last": F.max_by(value, F.when(F.col(value).isNotNull(), F.col("timestamp")))}[agg]
    return rows.groupBy(*key, "__b").agg(F.max("timestamp").alias("x"), y.alias("y")).drop("__b")


def latency(arrivals: DataFrame) -> Column:
    return (F.col("received") - (F.col("timestamp") + F.col("window_ms"))).cast("double")


def latency_buckets(arrivals: DataFrame, width_ms: int = 1000) -> DataFrame:
    """Exact median latency per second of arrival. The newest second is still open and doesn't show."""
    rows = arrivals.select(latency(arrivals).alias("latency"), (F.col("received") - F.pmod("received", F.lit(width_ms))).alias("second"))
    newest = rows.agg(F.max("second").alias("__open"))
    return rows.groupBy("second").agg(F.median("latency").alias("latency")).join(F.broadcast(newest), F.col("second") < F.col("__open")).drop("__open")


def median_latency(arrivals: DataFrame, last: int = 500, order: str = "received") -> DataFrame:
    recent = arrivals.orderBy(F.desc(order), F.desc("timestamp"), "station", "sensor").limit(last)
    return recent.agg(F.median(latency(recent)).alias("latency_ms_p50"), F.count("*").alias("n"))


def throughput(arrivals: DataFrame, span_ms: int = 10_000, chunk_ms: int | None = None, at: str = "received") -> DataFrame:
    """Adds per_second: arrivals in the trailing span, this one included, per second. Arrivals at the same time count each
    other, those without a time among themselves.

    The number in the span is a running sum in which each arrival enters once and leaves once, so it costs the same
    however many a span holds. Sums run by chunks, chunk_ms long (a span, if not given): beside its own rows a chunk gets
    a row for each time that it opens with, and one for each at which something leaves the span within it."""
    width = chunk_ms or span_ms
    chunk = lambda t: F.floor(t / F.lit(width)).cast("long")
    at_, in_, n, c = (F.col(x) for x in (at, "__in", "__n", "__c"))
    own = arrivals.withColumns({"__c": chunk(at_), "__t": at_.cast("long"), "__n": F.lit(1).cast("long"), "__in": F.lit(True)})
    met = arrivals.where(at_.isNotNull()).groupBy(at_.cast("long").alias("__t")).agg(F.count("*").alias("__n"))
    left = F.col("__t") + F.lit(span_ms + 1)
    reached = met.withColumn("__c", F.explode(F.sequence(chunk(F.col("__t")), chunk(left))))
    # as a chunk opens, what came before it and hasn't left is a sum; what leaves within it goes at its own time
    opens = reached.where(chunk(F.col("__t")) < c).select("__c", (c * width).alias("__t"), "__n")
    opens = opens.groupBy("__c", "__t").agg(F.sum("__n").alias("__n"))
    leaves = reached.where(chunk(left) == c).select("__c", left.alias("__t"), (-n).alias("__n"))
    both = own.unionByName(opens.unionByName(leaves).withColumn("__in", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("__c").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("per_second", F.sum("__n").over(w) / F.lit(span_ms / 1000.0)).where(in_).drop("__c", "__t", "__n", "__in")


def median_spacing(rows: DataFrame, key: list[str], default: int, last: int = 20) -> DataFrame:
    """Upper median of the last positive gaps between a series' timestamps."""
    w = Window.partitionBy(*key).orderBy("timestamp")
    gaps = keep_last(rows, key, last + 1).withColumn("g", F.col("timestamp") - F.lag("timestamp").over(w))
    g = gaps.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("g") > 0, F.col("g")))).alias("g"))
    return g.select(*key, F.coalesce(F.get("g", F.floor(F.size("g") / 2).cast("int")), F.lit(default)).alias("spacing"))


def backfill(live: DataFrame, archive: DataFrame, capacity: int, key: list[str] = SERIES) -> DataFrame:
    """Live rows and, before a series' first live one, the newest archived rows that there is room for."""
    first = live.groupBy(*key).agg(F.min("timestamp").alias("__first"), F.count("*").alias("__n"))
    older = archive.join(first, key, "left").where(F.col("__first").isNull() | (F.col("timestamp") < F.col("__first")))
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("timestamp")))
    older = older.withColumn("__r", r).where(F.col("__r") <= capacity - F.coalesce("__n", F.lit(0))).select(archive.columns)
    return live.withColumn("origin", F.lit("live")).unionByName(older.withColumn("origin", F.lit("archive")))


def delta(rows: DataFrame, cursors: DataFrame, range_ms: int, interval: str = "window_ms", key: list[str] = SERIES) -> DataFrame:
    """Points after each trace's cursor (all where it has none), the newest that fill one range."""
    new = rows.join(cursors, key, "left").where(F.col("cursor").isNull() | (F.col("timestamp") > F.col("cursor"))).drop("cursor")
    cap = F.greatest(F.lit(1), F.floor(F.lit(range_ms) / F.greatest(F.col(interval), F.lit(1))) + 1)
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("timestamp")))
    return new.withColumn("__r", r).where(F.col("__r") <= cap).drop("__r")


def counter_rate(samples: DataFrame, key: list[str], bucket_ms: int, value: str = "value", order: str = "timestamp") -> DataFrame:
    """Per-second increase of a counter in each time bucket; a fall is a restart from zero."""
    w = Window.partitionBy(*key).orderBy(order)
    prev = F.lag(value).over(w)
    rows = samples.withColumn("__d", F.when(prev.isNull(), 0).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev))
    return rows.groupBy(*key, (F.col("timestamp") - F.pmod("timestamp", F.lit(bucket_ms))).alias("bucket")).agg((F.sum("__d") / F.lit(bucket_ms / 1000.0)).alias("rate"))


def histogram_quantile(counts: DataFrame, key: list[str], q: float) -> DataFrame:
    """counts: key, le (upper bound, the last infinite), n (observations up to le). Linear within the bucket that the
    quantile falls in; the last finite bound where that is the infinite one."""
    w = Window.partitionBy(*key).orderBy("le")
    rows = counts.withColumn("__lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("__below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rank = F.lit(q) * F.max("n").over(Window.partitionBy(*key))
    rows = rows.withColumn("__rank", rank).where(F.col("n") >= F.col("__rank"))
    first = rows.groupBy(*key).agg(F.min_by(F.struct("le", "n", "__lo", "__below", "__rank"), "le").alias("b"))
    inside = F.col("b.__lo") + (F.col("b.le") - F.col("b.__lo")) * (F.col("b.__rank") - F.col("b.__below")) / F.nullif(F.col("b.n") - F.col("b.__below"), F.lit(0))
    return first.select(*key, F.when(F.col("b.le") == float("inf"), F.col("b.__lo")).otherwise(inside).alias("quantile"))


def health_grid(metrics: DataFrame, sensors: list[int], value: str) -> DataFrame:
    """Stations by sensors; the sensors are named, so the pivot needs no pass of its own."""
    return metrics.groupBy("station").pivot("sensor", sensors).agg(F.first(value, ignorenulls=True))


def signature(rows: DataFrame, by: list[str]) -> DataFrame:
    """sha1 of each group's rows in order, to tell whether a view changed."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c not in by]))).alias("v"))
    return packed.select(*by, F.sha1(F.to_json("v")).alias("digest"))
