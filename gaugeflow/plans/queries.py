"""One query per operator over the test tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import alerts, archive, forecast, regime, views, windows
from ..sources import schemas, simulator
from . import fixtures as fx
from .fixtures import DAY, HOUR, NOW

LATENESS = HOUR // 2
SERIES = ["station", "sensor"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


# ---- sources and projections


@query
def raw_view(s, d):
    return fx.raw(s, d).select("event_id", "station", "timestamp", F.col("values")[0].alias("v0"), F.col("values")[1].alias("v1"), "regime")


@query
def explode_channels(s, d):
    return windows.explode_channels(fx.raw(s, d)).select("event_id", "station", "sensor", "timestamp", "value")


@query
def nonfinite_filter(s, d):
    return windows.nonfinite_counts(windows.explode_channels(fx.nonfinite(s, d)), "station", "sensor")


@query
def window_alignment(s, d):
    """Starts of windows around the epoch too: event times shifted to straddle it."""
    r = fx.raw(s, d).withColumn("t", F.col("timestamp") - NOW)
    return r.select("event_id", "t", expr.align(F.col("t"), HOUR).alias("start"), expr.next_tick(F.col("t"), 500).alias("tick"))


@query
def station_fanout(s, d):
    n = F.col("id")
    return s.range(26).select(F.concat(F.lit("Station"), F.char(n + 65)).alias("station"), (n + 7).alias("seed"))


@query
def station_token(s, d):
    e = fx.table(s, d, "customer").select(F.col("c_name").alias("name"))
    return e.select("name", expr.valid_station(F.col("name")).alias("ok"), expr.valid_station(F.concat("name", F.lit(".x"))).alias("dotted"))


@query
def quarantine_split(s, d):
    """Every fiftieth message is cut short and must be set aside; the others decode to what was sent."""
    r = fx.raw(s, d)
    text = F.to_json(F.struct("station", "timestamp", "values", "regime"))
    lines = r.select("event_id", F.when(F.col("event_id") % 50 == 0, F.left(text, F.lit(20))).otherwise(text).alias("value"))
    got = schemas.decode(lines, "raw")
    return got.select("event_id", "ok", F.when(F.col("ok"), F.col("m.station")).alias("station"), F.when(F.col("ok"), F.col("m.timestamp")).alias("timestamp"), F.when(F.col("ok"), F.col("m.regime").cast("int")).alias("regime"))


@query
def to_json_contract(s, d):
    rows = fx.stats(s, d).select("station", "sensor", "timestamp", "window_ms", "count", F.when(F.col("regime") > 0, F.col("regime")).alias("regime"))
    return schemas.encode(rows)


@query
def log_replay(s, d):
    return fx.raw(s, d).where(F.col("timestamp").between(NOW, NOW + DAY)).groupBy("station").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query
def narrowing_casts(s, d):
    """Counts and window lengths too wide for storage are rejected, as are rows that break a check."""
    rows = fx.stats(s, d).withColumn("window_ms", F.when(F.col("timestamp") % (5 * HOUR) == 0, F.lit(3_000_000_000)).when(F.col("timestamp") % (7 * HOUR) == 0, F.lit(0)).otherwise(F.col("window_ms")).cast("long"))
    good, bad = archive.narrowed(rows)
    return good.groupBy("station").agg(F.count("*").alias("n")).withColumn("kept", F.lit(True)).unionByName(bad.groupBy("station").agg(F.count("*").alias("n")).withColumn("kept", F.lit(False)))


@query
def clock_format(s, d):
    return fx.raw(s, d).select("event_id", expr.clock(F.col("timestamp"), 330).alias("clock"))


@query
def rounding(s, d):
    r = fx.raw(s, d)
    return r.select("event_id", F.round(F.col("values")[0], 2).alias("r2"), F.round(F.col("values")[0] / 7, 6).alias("r6"))


@query
def affine(s, d):
    return fx.raw(s, d).select("event_id", F.round((F.col("values")[0] - 10.0) / 4.0, 6).alias("y"))


# ---- windows and late data


@query
def tumbling_stats(s, d):
    return windows.tumbling(fx.raw(s, d), HOUR).withColumns(r6("mean"))


@query
def tumbling_finite(s, d):
    return windows.tumbling(fx.nonfinite(s, d), HOUR).withColumns(r6("mean"))


@query
def majority_regime(s, d):
    return windows.majority(fx.raw(s, d), HOUR)


@query
def stats_with_regime(s, d):
    return fx.stats(s, d).withColumns(r6("mean"))


@query
def bulk_windows(s, d):
    """Daily windows of line items: stations are return flags, channels quantity and price."""
    li = fx.table(s, d, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("station"), expr.epoch_ms(F.col("l_shipdate").cast("timestamp_ntz")).alias("timestamp"), F.array("l_quantity", "l_extendedprice").alias("values"))
    return windows.tumbling(rows, DAY).withColumns(r6("mean"))


@query
def late_events(s, d):
    return windows.mark_late(fx.disordered(s, d), HOUR, LATENESS).select("event_id", "station", "timestamp", "late")


@query
def late_by_global_bound(s, d):
    late = windows.mark_late_globally(fx.disordered(s, d), HOUR, LATENESS)
    return late.groupBy("station").agg(F.count_if("late").alias("late"), F.count("*").alias("n"))


@query
def on_time_stats(s, d):
    rows = windows.mark_late(fx.disordered(s, d), HOUR, LATENESS).where(~F.col("late"))
    return windows.stats(rows, HOUR).withColumns(r6("mean"))


@query
def running_max(s, d):
    rows = fx.disordered(s, d)
    out = windows.running_max_before(rows, "station", ["arrival", "event_id"], F.floor(F.col("arrival") / DAY), "timestamp", "before")
    return out.select("event_id", "before")


@query
def open_windows(s, d):
    return windows.open_windows(fx.raw(s, d), HOUR, LATENESS)


@query
def idle_close(s, d):
    rows = fx.raw(s, d).where(F.col("timestamp") < NOW - F.length("station") * HOUR / 4)
    return windows.idle_close(rows, HOUR, LATENESS, 2 * HOUR, NOW)


@query
def strictly_newer(s, d):
    rows = fx.disordered(s, d)
    return windows.strictly_newer(rows, ["station"], ["arrival", "event_id"]).select("event_id", "station", "timestamp")


# ---- archive


@query
def dedup_first_wins(s, d):
    rows = fx.duplicated(s, d).select("event_id", "station", "timestamp", "copy")
    return archive.first_wins(rows, ["copy"], ["event_id"])


@query
def upsert_antijoin(s, d):
    rows = fx.stats(s, d).withColumns(r6("mean"))
    stored = rows.where(F.col("timestamp") % (2 * HOUR) == 0)
    return archive.new_rows(rows.unionByName(rows.where("sensor = 0")), stored, ["window_ms"]).select("station", "sensor", "timestamp", "mean", "count")


@query
def missing_keys(s, d):
    rows = fx.stats(s, d)
    return archive.missing_keys(rows, rows.where(F.col("timestamp") % (3 * HOUR) != 0))


@query
def latest_n(s, d):
    return archive.stats_query(fx.stats(s, d), archive.StatsQuery(limit=100)).withColumns(r6("mean"))


@query
def range_query(s, d):
    q = archive.StatsQuery.parse({"station": "click", "sensor": "1", "start_ts": str(NOW - 3 * DAY), "end_ts": str(NOW), "limit": "50"})
    return archive.stats_query(fx.stats(s, d), q).withColumns(r6("mean"))


@query
def backfill_union(s, d):
    rows = fx.stats(s, d).select("station", "sensor", "timestamp", F.round("mean", 6).alias("mean"))
    return views.backfill(rows.where(F.col("timestamp") >= NOW), rows, 500)


# ---- forecasts


@query
def lag_diff(s, d):
    return forecast.lag_diff(fx.stats(s, d)).select(*SERIES, "timestamp", F.round("diff", 6).alias("diff"))


@query
def ar1_params(s, d):
    return forecast.ar1(fx.stats(s, d)).where("sigma2 IS NOT NULL").select(*SERIES, "timestamp", "n", F.round("phi", 6).alias("phi"), F.round("c", 4).alias("c"), F.round("sigma2", 3).alias("sigma2"))


@query
def forecast_points(s, d):
    return fx.predictions(s, d).select(*SERIES, "origin_ts", "horizon", "timestamp", F.round("point", 4).alias("point"))


@query
def forecast_intervals(s, d):
    return fx.predictions(s, d).select(*SERIES, "origin_ts", "horizon", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query
def forecast_messages(s, d):
    m = forecast.messages(fx.predictions(s, d))
    return m.select(*SERIES, "origin_ts", F.size("timestamps").cast("long").alias("steps"), F.get("timestamps", 0).alias("first_ts"), F.round(F.get("forecasts", 0), 4).alias("one_step"), "confidence")


@query
def forecast_long_form(s, d):
    """The message's parallel arrays as rows again."""
    m = forecast.messages(fx.predictions(s, d))
    rows = m.select(*SERIES, "origin_ts", F.posexplode(F.arrays_zip("timestamps", "forecasts")).alias("pos", "f"))
    return rows.select(*SERIES, "origin_ts", (F.col("pos") + 1).alias("horizon"), F.col("f.timestamps").alias("timestamp"), F.round("f.forecasts", 4).alias("point"))


@query
def forecast_scores(s, d):
    return fx.scored(s, d).select(*SERIES, "horizon", "timestamp", F.round("abs_error", 4).alias("abs_error"), F.round("naive_error", 6).alias("naive_error"), "covered")


@query
def rolling_mae(s, d):
    return fx.measured(s, d).select(*SERIES, "horizon", "timestamp", "n", F.round("mae", 4).alias("mae"))


@query
def rolling_mase(s, d):
    return fx.measured(s, d).select(*SERIES, "horizon", "timestamp", F.round("mase", 4).alias("mase"))


@query
def rolling_coverage(s, d):
    return fx.measured(s, d).select(*SERIES, "horizon", "timestamp", F.round("coverage", 6).alias("coverage"))


@query
def metrics_asof(s, d):
    return forecast.metrics_asof(fx.predictions(s, d), fx.measured(s, d)).select(*SERIES, "origin_ts", "horizon", "n", F.round("mae", 4).alias("mae"), F.round("coverage", 6).alias("coverage"))


@query
def metric_history(s, d):
    """Metric points of horizons with at least 20 scores."""
    return forecast.metrics_asof(fx.predictions(s, d), fx.measured(s, d)).where("n >= 20").select(*SERIES, "origin_ts", "horizon", F.round("mase", 4).alias("mase"))


@query
def newest_horizon(s, d):
    """All steps of each series' newest forecast only."""
    p = fx.predictions(s, d)
    newest = p.groupBy(*SERIES).agg(F.max("origin_ts").alias("origin_ts"))
    return p.join(newest, [*SERIES, "origin_ts"]).select(*SERIES, "origin_ts", "horizon", "timestamp", F.round("point", 4).alias("point"))


# ---- alerts


def one_step(s, d) -> DataFrame:
    return fx.scored(s, d).where("horizon = 1")


@query
def miss_runs(s, d):
    return alerts.miss_runs(one_step(s, d)).select(*SERIES, "timestamp", F.col("misses").cast("long").alias("misses"))


@query
def anomaly_candidates(s, d):
    return alerts.anomaly_candidates(one_step(s, d)).select(*SERIES, "timestamp", "extreme", "severity", F.col("misses").cast("long").alias("misses"))


@query
def anomaly_cooldown(s, d):
    return alerts.cooled_down(alerts.anomaly_candidates(one_step(s, d), 1), 36 * HOUR).select(*SERIES, "timestamp")


@query
def anomaly_messages(s, d):
    m = alerts.anomaly_messages(alerts.cooled_down(alerts.anomaly_candidates(one_step(s, d))))
    return m.select("id", "rule", "severity", "state", F.round("value", 6).alias("value"))


@query
def calibration_hysteresis(s, d):
    return alerts.calibration(fx.measured(s, d).where("horizon = 1"), 0.975, 0.985).select(*SERIES, "timestamp", "state", F.round("coverage", 6).alias("coverage"))


@query
def degraded_hysteresis(s, d):
    return alerts.degraded(fx.measured(s, d).where("horizon = 1"), 0.74, 0.735).select(*SERIES, "timestamp", "state", F.round("mase", 4).alias("mase"))


@query
def regime_change_runs(s, d):
    rows = fx.raw(s, d).select("station", "timestamp", F.col("event_id").alias("seq"), F.col("regime").alias("state"))
    return alerts.regime_changes(rows, 4).select("station", "seq", "timestamp", "previous", "state")


@query
def confusion_rolling(s, d):
    c = regime.confusion(fx.states(s, d), "seq", 300)
    return c.select("station", "seq", "n_scored", *[f"c{i}{j}" for i in range(3) for j in range(3)])


@query
def best_permutation_accuracy(s, d):
    return regime.confusion(fx.states(s, d), "seq", 300).select("station", "seq", "matched", F.round("accuracy", 6).alias("accuracy"))


@query
def accuracy_sustained(s, d):
    rows = regime.confusion(fx.states(s, d), "seq", 200)
    return alerts.low_accuracy(rows, 0.80, 0.81, 4 * HOUR, 100).select("station", "seq", "timestamp", "state", F.round("accuracy", 6).alias("accuracy"))


@query
def stateful_messages(s, d):
    """Messages of the rules that fire and resolve, texts included, of every series and station."""
    m = fx.measured(s, d).where("horizon = 1")
    low = alerts.low_accuracy(regime.confusion(fx.states(s, d), "seq", 200), 0.80, 0.81, 4 * HOUR, 100)
    every = [alerts.calibration_messages(alerts.calibration(m, 0.975, 0.985), 0.975), alerts.degraded_messages(alerts.degraded(m, 0.74, 0.735)), alerts.accuracy_messages(low, 0.80, 4 * HOUR)]
    out = every[0].unionByName(every[1]).unionByName(every[2])
    return out.withColumn("value", F.round("value", 4))


@query
def regime_change_messages(s, d):
    rows = fx.raw(s, d).select("station", "timestamp", F.col("event_id").alias("seq"), F.col("regime").alias("state"))
    return alerts.regime_messages(alerts.regime_changes(rows, 4))


@query
def derived_messages(s, d):
    """Messages that follow from arrivals alone: silent series, and a sustained latency."""
    a = fx.arrivals(s, d)
    old = alerts.stale_messages(alerts.stale(a.where(F.col("received") < NOW - F.length("station") * F.col("window_ms")), NOW), NOW)
    late = a.withColumn("received", F.col("received") + 150)
    return old.unionByName(alerts.latency_messages(alerts.latency_sustained(views.latency_buckets(late), late)))


@query
def active_alerts(s, d):
    return alerts.active(fx.alert_log(s, d).where(F.col("timestamp") <= NOW), NOW, ttl_ms=6 * HOUR)


@query
def alert_feed(s, d):
    return alerts.feed(fx.alert_log(s, d), ["click", "view", "purchase"], [("click", 0), ("view", 1)])


@query
def alert_counts(s, d):
    return fx.alert_log(s, d).groupBy("station", "sensor").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("serious", "critical")).alias("severe"))


@query
def stale_series(s, d):
    rows = fx.arrivals(s, d).where(F.col("received") < NOW - F.length("station") * F.col("window_ms"))
    return alerts.stale(rows, NOW).select(*SERIES, "last_received")


# ---- latency and throughput


@query
def latency_buckets(s, d):
    return views.latency_buckets(fx.arrivals(s, d))


@query
def latency_sustained(s, d):
    a = fx.arrivals(s, d).withColumn("received", F.col("received") + 150)
    return alerts.latency_sustained(views.latency_buckets(a), a)


@query
def median_latency(s, d):
    return views.median_latency(fx.arrivals(s, d))


@query
def throughput_trailing(s, d):
    rows = fx.raw(s, d).select("event_id", F.col("timestamp").alias("received"))
    return views.throughput(rows, 10 * HOUR).select("event_id", F.round("per_second", 9).alias("per_second"))


@query
def counter_rate(s, d):
    rows = fx.raw(s, d).select("station", "timestamp", "event_id", (F.col("event_id") % 1000).alias("value"))
    return views.counter_rate(rows, ["station"], DAY, order="event_id").select("station", "bucket", F.round("rate", 9).alias("rate"))


@query
def histogram_quantile(s, d):
    bounds = F.array(*[F.lit(float(b)) for b in (5, 10, 25, 50, 100, 250)], F.lit(float("inf")))
    rows = fx.raw(s, d).select("station", F.col("values")[0].alias("v"), F.explode(bounds).alias("le"))
    counts = rows.groupBy("station", "le").agg(F.count_if(F.col("v") <= F.col("le")).alias("n"))
    return views.histogram_quantile(counts, ["station"], 0.95).select("station", F.round("quantile", 6).alias("quantile"))


@query
def dashboard_aggregates(s, d):
    """Per-day sum, mean, most and quantiles of a gauge."""
    r = fx.raw(s, d).select(expr.align(F.col("timestamp"), DAY).alias("day"), F.col("values")[0].alias("v"))
    return r.groupBy("day").agg(F.round(F.sum("v"), 4).alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("v", F.lit(0.99)), 6).alias("p99"))


# ---- views


@query
def cross_section(s, d):
    out = views.cross_section(fx.stats(s, d).where("sensor = 0"), [], SERIES)
    return out.select("timestamp", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


@query
def station_section(s, d):
    out = views.cross_section(fx.stats(s, d), ["station"], SERIES)
    return out.select("station", "timestamp", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


@query
def aligned_metric_mean(s, d):
    m = fx.measured(s, d).where("horizon = 1 AND sensor = 0 AND mase IS NOT NULL")
    return views.cross_section(m, [], SERIES, "mase").select("timestamp", F.round("mean", 4).alias("mean"))


@query
def change_correlation(s, d):
    return views.change_correlation(fx.stats(s, d))


@query
def zscore_params(s, d):
    return views.zscore_params(fx.stats(s, d), SERIES).select(*SERIES, F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query
def zscore_compare(s, d):
    return views.compare(fx.stats(s, d), SERIES).select(*SERIES, "timestamp", F.round("z", 5).alias("z"))


def _decimated(agg: str):
    def run(s, d):
        return views.decimate(fx.stats(s, d), SERIES, 50, agg).select(*SERIES, "x", F.round("y", 6).alias("y"))

    return run


for _agg in ("mean", "min", "max", "last"):
    QUERIES[f"decimate_{_agg}"] = _decimated(_agg)


@query
def keep_last_n(s, d):
    return views.keep_last(fx.stats(s, d), SERIES, 60).select(*SERIES, "timestamp", F.round("mean", 6).alias("mean"))


@query
def every_nth(s, d):
    return views.every_nth(fx.raw(s, d), ["station"], 5, "event_id").select("event_id", "station", "timestamp")


@query
def median_spacing(s, d):
    return views.median_spacing(fx.stats(s, d), SERIES, HOUR).select(*SERIES, "spacing")


@query
def selection(s, d):
    return views.crop(views.select_series(fx.stats(s, d), ["click", "view", "absent"], [0]), NOW).select(*SERIES, "timestamp", "count")


@query
def distinct_series(s, d):
    return fx.stats(s, d).groupBy("station").agg(F.count_distinct("sensor").alias("sensors"), F.min("sensor").alias("least"), F.max("sensor").alias("most"), F.count("*").alias("n"))


def _newest_metrics(s, d) -> DataFrame:
    m = forecast.metrics_asof(fx.predictions(s, d), fx.measured(s, d)).where("horizon = 1")
    return m.groupBy(*SERIES).agg(F.max_by("mase", "origin_ts").alias("mase"), F.max_by("coverage", "origin_ts").alias("coverage"))


@query
def health_grid(s, d):
    g = views.health_grid(_newest_metrics(s, d), [0, 1], "mase")
    return g.select("station", F.round("0", 4).alias("s0"), F.round("1", 4).alias("s1"))


@query
def kpi_tiles(s, d):
    m = _newest_metrics(s, d).agg(F.round(F.avg("mase"), 4).alias("mase"), F.round(F.avg("coverage"), 6).alias("coverage"))
    a = alerts.active(fx.alert_log(s, d).where(F.col("timestamp") <= NOW), NOW, ttl_ms=6 * HOUR).agg(F.count("*").alias("active"), F.count_if(F.col("severity").isin("serious", "critical")).alias("severe"))
    lat = views.median_latency(fx.arrivals(s, d)).select("latency_ms_p50")
    return m.crossJoin(a).crossJoin(lat)


@query
def delta_since_cursor(s, d):
    rows = fx.stats(s, d)
    cursors = rows.where("sensor = 0").groupBy(*SERIES).agg((F.max("timestamp") - 2 * DAY).alias("cursor"))
    return views.delta(rows, cursors, DAY).select(*SERIES, "timestamp", F.round("mean", 6).alias("mean"))


@query
def view_signature(s, d):
    rows = fx.stats(s, d).groupBy("station", "sensor").agg(F.count("*").alias("n"), F.max("timestamp").alias("newest"))
    return rows.select("station", "sensor", F.sha1(F.concat_ws("|", "station", "sensor", "n", "newest")).alias("digest"))


@query
def argmax_state(s, d):
    r = fx.raw(s, d)
    p = F.array(F.col("event_id") % 7, F.col("event_id") % 5, F.col("event_id") % 3)
    return r.select("event_id", expr.argmax_first(p).alias("state"))


@query
def series_detail(s, d):
    """Actuals of one series beside what was forecast for them one step before."""
    rows = fx.stats(s, d).where("station = 'click' AND sensor = 0")
    one = fx.predictions(s, d).where("horizon = 1 AND station = 'click' AND sensor = 0").select("timestamp", "point", "lower", "upper")
    out = rows.join(one, "timestamp", "left")
    return out.select("timestamp", F.round("mean", 6).alias("actual"), *[F.round(c, 4).alias(c) for c in ("point", "lower", "upper")])


@query
def moving_average(s, d):
    w = Window.partitionBy("station").orderBy("event_id").rowsBetween(-12, 12)
    return fx.raw(s, d).select("event_id", F.round(F.sum(F.col("values")[0]).over(w) / 25.0, 6).alias("ma"))


@query
def state_lookup(s, d):
    """The model in force at each row, fitted every 600 rows from row 1201."""
    rows = regime.numbered(fx.raw(s, d), ["event_id"])
    fits = rows.where((F.col("r") >= 1201) & ((F.col("r") - 1201) % 600 == 0)).select("station", F.col("r").alias("fitted_at"))
    return regime.latest_fit(rows, fits)


# ---- models without a SQL twin


@query
def simulated_raw(s, d):
    return simulator.simulate(s, 3, 4000, seed=11)


@query
def regime_em(s, d):
    return regime.fit_segments(fx.raw(s, d), ["event_id"])


@query
def hamilton_filter(s, d):
    return regime.regime_messages(regime.detect(fx.raw(s, d), ["event_id"]))
