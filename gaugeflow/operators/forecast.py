"""Rolling AR(1) forecasts with prediction intervals, their scoring against actuals, and rolling metrics.

All frames count rows, so a gap in a series is bridged as if its ends were neighbours. Every step is a window or an
equi-join over (station, sensor); series are independent, so they spread over as many tasks as there are series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import t_value

SERIES = ["station", "sensor"]
LONGEST, LEAST = 60, 20
ALPHA = 0.02
SCORED = 200


def lag_diff(rows: DataFrame, value: str = "mean") -> DataFrame:
    """Adds prev and diff, the change from the series' row before."""
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    return rows.withColumn("prev", F.lag(value).over(w)).withColumn("diff", F.col(value) - F.col("prev"))


def ar1(rows: DataFrame, value: str = "mean", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Adds n, xbar, sxx, phi, c, sigma2 of the least-squares fit x[t+1] = c + phi x[t] over the last `longest` rows; null
    before there are `least` rows or where the values don't vary."""
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    frame = w.rowsBetween(-(longest - 2), 0)
    prev = F.lag(value).over(w)
    rows = rows.withColumn("prev", prev)
    fit = {f"__{k}": f(F.col(value), F.col("prev")).over(frame) for k, f in (("n", F.regr_count), ("xbar", F.regr_avgx), ("ybar", F.regr_avgy), ("sxx", F.regr_sxx), ("syy", F.regr_syy), ("sxy", F.regr_sxy))}
    rows = rows.withColumns(fit)
    sxx = F.when((F.col("__n") >= least - 1) & (F.col("__sxx") > 0), F.col("__sxx"))
    rows = rows.withColumn("sxx", sxx).withColumn("phi", F.col("__sxy") / F.col("sxx"))
    rows = rows.withColumn("c", F.col("__ybar") - F.col("phi") * F.col("__xbar"))
    sse = F.greatest(F.col("__syy") - F.col("phi") * F.col("__sxy"), F.lit(0.0))
    rows = rows.withColumn("sigma2", F.when(F.col("sxx").isNotNull(), sse / (F.col("__n") - 2)))
    return rows.withColumn("n", F.col("__n").cast("long")).withColumn("xbar", F.col("__xbar")).drop(*fit)


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def forecasts(rows: DataFrame, steps: int = 3, value: str = "mean", alpha: float = ALPHA, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """station, sensor, origin_ts, step_ms, origin_value, horizon, timestamp (target), point, lower, upper: one row per
    horizon of every row that has a fit. The interval has the noise of the steps and that of the estimated line."""
    fit = ar1(rows, value, longest, least).where(F.col("sigma2").isNotNull())
    phi, x, n, xbar, sxx = F.col("phi"), F.col(value), F.col("n"), F.col("xbar"), F.col("sxx")
    power = lambda k: F.lit(1.0) if k == 0 else _product(phi, k)
    each = []
    for h in range(1, steps + 1):
        s = _sum([power(j) for j in range(h)])
        slope = _sum([j * power(j - 1) for j in range(1, h)])
        point = F.col("c") * s + power(h) * x
        g1 = F.col("c") * slope + h * power(h - 1) * x
        var = F.col("sigma2") * (_sum([power(2 * j) for j in range(h)]) + s * s / n + (g1 - s * xbar) * (g1 - s * xbar) / sxx)
        each.append(F.struct(F.lit(h).alias("horizon"), point.alias("point"), var.alias("var")))
    t = t_value(n - 2, 1 - alpha / 2, least - 3, longest - 3)
    out = fit.select(*SERIES, F.col("timestamp").alias("origin_ts"), F.col("window_ms").alias("step_ms"), x.alias("origin_value"), t.alias("t"), F.explode(F.array(*each)).alias("f"))
    out = out.select("*", "f.*").where(F.col("var") >= 0)
    half = F.col("t") * F.sqrt("var")
    return out.select(*SERIES, "origin_ts", "step_ms", "origin_value", "horizon", (F.col("origin_ts") + F.col("horizon") * F.col("step_ms")).alias("timestamp"), "point", (F.col("point") - half).alias("lower"), (F.col("point") + half).alias("upper"))


def _product(x: Column, k: int) -> Column:
    return reduce(lambda a, b: a * b, [x] * k)


def messages(rows: DataFrame, metrics: DataFrame | None = None, confidence: float = 1 - ALPHA) -> DataFrame:
    """One row per origin with the horizons as parallel arrays, the shape of the forecast message."""
    packed = rows.groupBy(*SERIES, "origin_ts", "step_ms").agg(F.sort_array(F.collect_list(F.struct("horizon", "timestamp", "point", "lower", "upper"))).alias("f"))
    take = lambda c: F.transform("f", lambda x: x[c])
    out = packed.select(*SERIES, "origin_ts", "step_ms", take("timestamp").alias("timestamps"), take("point").alias("forecasts"), take("lower").alias("lower_ci"), take("upper").alias("upper_ci"), F.lit(confidence).alias("confidence"))
    if metrics is None:
        return out
    m = metrics.groupBy(*SERIES, "origin_ts").agg(F.sort_array(F.collect_list(F.struct("horizon", "n", "mae", "mase", "coverage"))).alias("metrics"))
    return out.join(m, [*SERIES, "origin_ts"], "left")


def scores(predictions: DataFrame, rows: DataFrame, horizons: tuple[int, ...] = (1, 3), value: str = "mean") -> DataFrame:
    """Predictions of the scored horizons that meet the actual of their target window; those for windows that never come
    are lost. A target is met once at most, as a series has one row per window."""
    actual = rows.select(*SERIES, "timestamp", F.col(value).alias("actual"))
    met = predictions.where(F.col("horizon").isin(*set(horizons))).join(actual, [*SERIES, "timestamp"])
    return met.select(
        *SERIES, "horizon", "origin_ts", "timestamp", "actual", "point", "lower", "upper",
        F.abs(F.col("actual") - F.col("point")).alias("abs_error"), F.abs(F.col("actual") - F.col("origin_value")).alias("naive_error"), F.col("actual").between(F.col("lower"), F.col("upper")).alias("covered"),
    )


def rolling_metrics(scored: DataFrame, last: int = SCORED) -> DataFrame:
    """Adds n, mae, mase, coverage over the series and horizon's last scores, this one included; mase is null where the
    naive errors sum to zero."""
    w = Window.partitionBy(*SERIES, "horizon").orderBy("timestamp").rowsBetween(-(last - 1), 0)
    naive = F.sum("naive_error").over(w)
    return scored.withColumns({
        "n": F.count("*").over(w), "mae": F.avg("abs_error").over(w), "mase": F.sum(F.when(F.col("naive_error").isNotNull(), F.col("abs_error"))).over(w) / F.when(naive > 0, naive), "coverage": F.avg(F.col("covered").cast("double")).over(w),
    })


def metrics_asof(predictions: DataFrame, measured: DataFrame, horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """station, sensor, origin_ts, horizon, n, mae, mase, coverage: what was known of each horizon when a forecast was
    made, scores of that very window included. Without any score n is 0 and the rest null."""
    origins = predictions.select(*SERIES, "origin_ts").distinct().withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in sorted(set(horizons))])))
    known = F.struct("n", "mae", "mase", "coverage")
    both = origins.select(*SERIES, "horizon", F.col("origin_ts").alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("struct<n:bigint,mae:double,mase:double,coverage:double>").alias("m"))
    both = both.unionByName(measured.select(*SERIES, "horizon", F.col("timestamp").alias("ts"), F.lit(0).alias("kind"), known.alias("m")))
    w = Window.partitionBy(*SERIES, "horizon").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("m", F.last("m", ignorenulls=True).over(w)).where(F.col("kind") == 1)
    return got.select(*SERIES, F.col("ts").alias("origin_ts"), "horizon", F.coalesce("m.n", F.lit(0)).alias("n"), "m.mae", "m.mase", "m.coverage")
