"""Alert rules over scored forecasts, regimes and arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["station", "sensor"]
COVERAGE_FLOOR, COVERAGE_RECOVER = 0.93, 0.95
MASE_CEILING, MASE_RECOVER = 1.10, 1.02
ACCURACY_FLOOR, ACCURACY_RECOVER = 0.70, 0.75
MIN_SCORED, MIN_REGIME_SCORED = 100, 600
COOLDOWN_MS, SUSTAIN_MS, EVENT_TTL_MS = 10_000, 30_000, 30_000
MISSES, PERSIST = 2, 20
STALE_WINDOWS, LATENCY_ALERT_MS, LATENCY_BUCKETS = 6, 100.0, 30
ONE_SHOT, STATEFUL = ("anomaly", "regime_change"), ("calibration", "model_degraded", "regime_accuracy")


def miss_runs(scored: DataFrame) -> DataFrame:
    """Adds misses: length of the run of uncovered scores that ends here, 0 if this one is covered."""
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    island = F.sum(F.col("covered").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy(*SERIES, "__i").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("__i", island).withColumn("misses", F.sum((~F.col("covered")).cast("int")).over(run)).drop("__i")


def anomaly_candidates(scored: DataFrame, misses: int = MISSES) -> DataFrame:
    """Scores that would raise an anomaly: a run of misses, or one farther outside than half the interval's width."""
    rows = miss_runs(scored)
    half = (F.col("upper") - F.col("lower")) / 2
    excess = F.when(F.col("actual") > F.col("upper"), F.col("actual") - F.col("upper")).otherwise(F.col("lower") - F.col("actual"))
    rows = rows.withColumn("extreme", (F.col("misses") > 0) & (half > 0) & (excess > half))
    return rows.where(F.col("extreme") | (F.col("misses") >= misses)).withColumn("severity", F.when(F.col("extreme"), "serious").otherwise("warning"))


def cooled_down(candidates: DataFrame, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """Candidates that fire when each fired one silences its series for cooldown_ms.

    The rule refers to its own outcome, so it is a fold over the series' candidate times in order. Candidates are rare;
    only their times are gathered, and chains are cut wherever two candidates lie a cooldown apart, since the later of
    such two always fires: no series' whole history meets in one array.
    """
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    gap = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w) >= cooldown_ms, F.lit(True))
    rows = candidates.withColumn("__chain", F.sum(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("fired"))

    def step(acc: Column, ts: Column) -> Column:
        go = acc["last"].isNull() | (ts - acc["last"] >= cooldown_ms)
        return F.when(go, F.struct(ts.alias("last"), F.concat(acc["fired"], F.array(ts)).alias("fired"))).otherwise(acc)

    fired = rows.groupBy(*SERIES, "__chain").agg(F.aggregate(F.array_sort(F.collect_list("timestamp")), zero, step, lambda a: a["fired"]).alias("t"))
    return candidates.join(fired.select(*SERIES, F.explode("t").alias("timestamp")), [*SERIES, "timestamp"])


def hysteresis(rows: DataFrame, key: list[str], fire: Column, recover: Column, order: str = "timestamp") -> DataFrame:
    """Rows at which the state changes, with state firing or resolved. fire and recover exclude each other; a row with
    neither, or null in both, keeps the state. It starts resolved, silently."""
    w = Window.partitionBy(*key).orderBy(order)
    signal = F.when(fire, 1).when(recover, 0)
    rows = rows.withColumn("__s", F.coalesce(F.last(signal, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.withColumn("__p", F.lag("__s", 1, 0).over(w))
    return rows.where(F.col("__s") != F.col("__p")).withColumn("state", F.when(F.col("__s") == 1, "firing").otherwise("resolved")).drop("__s", "__p")


def calibration(measured: DataFrame, floor: float = COVERAGE_FLOOR, recover: float = COVERAGE_RECOVER, least: int = MIN_SCORED) -> DataFrame:
    known = (F.col("n") >= least) & F.col("coverage").isNotNull()
    return hysteresis(measured, SERIES, known & (F.col("coverage") < floor), known & (F.col("coverage") >= recover))


def degraded(measured: DataFrame, ceiling: float = MASE_CEILING, recover: float = MASE_RECOVER, least: int = MIN_SCORED) -> DataFrame:
    known = (F.col("n") >= least) & F.col("mase").isNotNull()
    return hysteresis(measured, SERIES, known & (F.col("mase") > ceiling), known & (F.col("mase") <= recover))


def low_accuracy(rows: DataFrame, floor: float = ACCURACY_FLOOR, recover: float = ACCURACY_RECOVER, sustain_ms: int = SUSTAIN_MS, least: int = MIN_REGIME_SCORED, order: str = "seq") -> DataFrame:
    """rows: station, timestamp, order, accuracy, n_scored. Fires when accuracy stayed below the floor for sustain_ms; any
    reading at or over the floor starts that anew. Rows with too few scores don't count at all."""
    rows = rows.where(F.col("accuracy").isNotNull() & (F.col("n_scored") >= least))
    w = Window.partitionBy("station").orderBy(order)
    low = F.col("accuracy") < floor
    rows = rows.withColumn("__i", F.sum((~low).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(low, F.struct(order, "timestamp"))).over(Window.partitionBy("station", "__i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__since", since["timestamp"])
    out = hysteresis(rows, ["station"], low & (F.col("timestamp") - F.col("__since") >= sustain_ms), F.col("accuracy") >= recover, order)
    return out.drop("__i", "__since")


def regime_changes(rows: DataFrame, persist: int = PERSIST, order: str = "seq") -> DataFrame:
    """rows: station, timestamp, order, state. The row at which a state other than the confirmed one has held for
    `persist` rows; the first confirmed state is silent. Adds previous."""
    rows = rows.where(F.col("state").isNotNull())
    w = Window.partitionBy("station").orderBy(order)
    change = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("__i", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("station", "__i").orderBy(order))).where(F.col("__r") == persist)
    rows = rows.withColumn("previous", F.lag("state").over(w)).drop("__i", "__r")
    return rows.where(F.col("previous").isNotNull() & (F.col("previous") != F.col("state")))


def stale(arrivals: DataFrame, now_ms: int, windows: int = STALE_WINDOWS) -> DataFrame:
    """arrivals: station, sensor, window_ms, received. Series without a window for more than `windows` window lengths."""
    last = arrivals.groupBy(*SERIES).agg(F.max_by("window_ms", "received").alias("window_ms"), F.max("received").alias("last_received"))
    return last.where(F.lit(now_ms) - F.col("last_received") > windows * F.col("window_ms"))


def latency_sustained(buckets: DataFrame, stations: DataFrame, above: float = LATENCY_ALERT_MS, last: int = LATENCY_BUCKETS) -> DataFrame:
    """buckets: second, latency. One row per station if the last recorded buckets all lie above the bound."""
    recent = buckets.orderBy(F.desc("second")).limit(last).agg(F.count("*").alias("n"), F.min("latency").alias("least"), F.max("latency").alias("peak"), F.max("second").alias("timestamp"))
    return stations.select("station").distinct().crossJoin(F.broadcast(recent.where((F.col("n") == last) & (F.col("least") > above)))).select("station", "timestamp", "peak")


def active(alerts: DataFrame, now_ms: int, derived: DataFrame | None = None, ttl_ms: int = EVENT_TTL_MS, order: str = "seq") -> DataFrame:
    """Alerts in force: stateful rules whose newest message per (rule, station, sensor) is firing, one-shot alerts no
    older than ttl_ms, and derived ones."""
    newest = alerts.where(F.col("rule").isin(*STATEFUL)).groupBy("rule", "station", "sensor").agg(F.max_by(F.struct(*alerts.columns), order).alias("a")).select("a.*").where(F.col("state") == "firing")
    recent = alerts.where(F.col("rule").isin(*ONE_SHOT) & (F.lit(now_ms) - F.col("timestamp") <= ttl_ms))
    out = newest.unionByName(recent)
    return out if derived is None else derived.unionByName(out)


def alert_id(rule: str) -> Column:
    """rule:station:sensor:timestamp; a change of regime has no sensor, a station's accuracy has -1."""
    sensor = [] if rule == "regime_change" else [F.lit("-1")] if rule == "regime_accuracy" else [F.col("sensor").cast("string")]
    return F.concat_ws(":", F.lit(rule), "station", *sensor, F.col("timestamp").cast("string"))


def anomaly_messages(fired: DataFrame) -> DataFrame:
    text = F.format_string("Window mean %.2f outside the forecast interval [%.2f, %.2f]", "actual", "lower", "upper")
    return fired.select(alert_id("anomaly").alias("id"), F.lit("anomaly").alias("rule"), "severity", F.lit("firing").alias("state"), *SERIES, "timestamp", text.alias("message"), F.col("actual").alias("value"))


MESSAGE = ["id", "rule", "severity", "state", "station", "sensor", "timestamp", "message", "value"]


def _fixed(x: Column, digits: int, unit: str) -> Column:
    """A number as text; a tie goes to the even digit."""
    return F.format_string(f"%.{digits}f%s", F.bround(x, digits), F.lit(unit))


def _messages(rows: DataFrame, rule: str, value: str | None, severity: Column, text: Column, id_: Column | None = None) -> DataFrame:
    """Alert rows; a rule about stations has no sensor, a derived one no value."""
    sensor = F.col("sensor") if "sensor" in rows.columns else F.lit(None)
    state = F.col("state") if rows.schema["state"].dataType.typeName() == "string" else F.lit("firing")
    made = {"id": id_ if id_ is not None else alert_id(rule), "rule": F.lit(rule), "severity": severity, "state": state, "station": F.col("station"), "sensor": sensor.cast("int"), "timestamp": F.col("timestamp"), "message": text, "value": (F.col(value) if value else F.lit(None)).cast("double")}
    return rows.select(*[c.alias(n) for n, c in made.items()])


def _turned(rows: DataFrame, rule: str, value: str, severity: str, fired: Column, recovered: Column) -> DataFrame:
    """Messages of a rule that fires and resolves; a resolution is information."""
    firing = F.col("state") == "firing"
    return _messages(rows, rule, value, F.when(firing, severity).otherwise("info"), F.when(firing, fired).otherwise(recovered))


def calibration_messages(turned: DataFrame, floor: float = COVERAGE_FLOOR) -> DataFrame:
    """turned: the rows of calibration()."""
    share = _fixed(F.col("coverage") * 100, 1, "%")
    return _turned(turned, "calibration", "coverage", "serious", F.concat(F.lit("Interval coverage "), share, F.lit(f" below {floor:.0%}")), F.concat(F.lit("Interval coverage recovered to "), share))


def degraded_messages(turned: DataFrame) -> DataFrame:
    """turned: the rows of degraded()."""
    mase = F.format_string("%.2f", "mase")
    return _turned(turned, "model_degraded", "mase", "warning", F.concat(F.lit("MASE "), mase, F.lit(": forecasts worse than naive persistence")), F.concat(F.lit("MASE recovered to "), mase))


def accuracy_messages(turned: DataFrame, floor: float = ACCURACY_FLOOR, sustain_ms: int = SUSTAIN_MS) -> DataFrame:
    """turned: the rows of low_accuracy()."""
    share = _fixed(F.col("accuracy") * 100, 0, "%")
    return _turned(turned, "regime_accuracy", "accuracy", "warning", F.concat(F.lit("Regime detection accuracy "), share, F.lit(f" below {floor:.0%} for {sustain_ms / 1000:.0f} s")), F.concat(F.lit("Regime detection accuracy recovered to "), share))


def regime_messages(changes: DataFrame) -> DataFrame:
    """changes: the rows of regime_changes(); state is the new regime."""
    return _messages(changes, "regime_change", "state", F.lit("info"), F.format_string("Regime change detected: R%d → R%d", F.col("previous").cast("int"), F.col("state").cast("int")))


def stale_messages(found: DataFrame, now_ms: int) -> DataFrame:
    """found: the rows of stale()."""
    rows = found.withColumn("timestamp", F.col("last_received")).withColumn("state", F.lit("firing"))
    text = F.concat(F.lit("No new window for "), _fixed((F.lit(now_ms) - F.col("last_received")) / 1000, 0, " s"))
    return _messages(rows, "stale", None, F.lit("critical"), text, F.concat_ws(":", F.lit("stale"), "station", F.col("sensor").cast("string")))


def latency_messages(found: DataFrame, above: float = LATENCY_ALERT_MS, last: int = LATENCY_BUCKETS) -> DataFrame:
    """found: the rows of latency_sustained()."""
    text = F.concat(F.lit(f"Pipeline latency above {above:.0f} ms for {last} s (peak "), _fixed(F.col("peak"), 0, " ms)"))
    return _messages(found.withColumn("state", F.lit("firing")), "latency", None, F.lit("warning"), text, F.concat_ws(":", F.lit("latency"), "station"))


def feed(alerts: DataFrame, stations: list[str], keys: list[tuple[str, int]], n: int = 25, order: str = "seq") -> DataFrame:
    """The newest alerts of a selection; an alert without a sensor belongs to its station."""
    return in_scope(alerts, stations, keys).orderBy(F.desc(order)).limit(n)


def in_scope(alerts: DataFrame, stations: list[str], keys: list[tuple[str, int]]) -> DataFrame:
    chosen = F.struct("station", "sensor").isin([F.struct(F.lit(s), F.lit(i)) for s, i in keys]) if keys else F.lit(False)
    return alerts.where(F.col("station").isin(stations) & (F.col("sensor").isNull() | chosen))
