"""The SQL that each query must equal, in DuckDB's dialect. Written apart from the operators: window functions and
joins over the same tables, no shared code but the constants."""

from __future__ import annotations

from ..functions.student import t_quantile
from .fixtures import DAY, HOUR, NOW

LATE = HOUR // 2
STAR = "station, sensor"


def floor_to(ts: str, w: int = HOUR) -> str:
    return f"({ts} - (({ts} % {w}) + {w}) % {w})"


RAW = """raw AS (SELECT event_id, event_type AS station, epoch_us(ts) // 1000 AS timestamp, value AS v0,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS v1, CAST(user_id % 3 AS INTEGER) AS regime FROM events)"""
EX = f"""{RAW}, ex AS (SELECT event_id, station, timestamp, regime, 0 AS sensor, v0 AS value FROM raw
  UNION ALL SELECT event_id, station, timestamp, regime, 1, v1 FROM raw)"""


def windows_of(ex: str, w: int = HOUR) -> str:
    return f"""SELECT station, sensor, {floor_to('timestamp', w)} AS timestamp, count(*) AS count, avg(value) AS mean, min(value) AS min, max(value) AS max
      FROM {ex} GROUP BY ALL"""


def majority_of(raw: str) -> str:
    return f"""SELECT station, timestamp, regime FROM (SELECT station, timestamp, regime, row_number() OVER (PARTITION BY station, timestamp ORDER BY n DESC, regime) AS r
      FROM (SELECT station, {floor_to('timestamp')} AS timestamp, regime, count(*) AS n FROM {raw} GROUP BY ALL)) WHERE r = 1"""


ST = f"""{EX}, win AS ({windows_of('ex')}), maj AS ({majority_of('raw')}),
 stats AS (SELECT station, sensor, timestamp, CAST({HOUR} AS BIGINT) AS window_ms, mean, min, max, count, regime FROM win JOIN maj USING (station, timestamp))"""
ARR = f"""{ST}, arrivals AS (SELECT *, timestamp + window_ms + (timestamp // {HOUR}) * 37 % 400 + sensor * 3 AS received FROM stats)"""
DIS = f"""{RAW}, dis AS (SELECT *, timestamp + (event_id * 7919 % 7200) * 1000 AS arrival FROM raw)"""
MARK = f"""{DIS}, seen AS (SELECT *, max(timestamp) OVER (PARTITION BY station ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
   max(timestamp) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_all FROM dis),
 marked AS (SELECT *, coalesce({floor_to('timestamp')} + {HOUR} <= before - {LATE}, false) AS late,
   coalesce({floor_to('timestamp')} + {HOUR} <= before_all - {LATE}, false) AS late_all FROM seen)"""
T_VALUES = ", ".join(f"({d}, {t_quantile(0.99, d)!r})" for d in range(17, 58))
FIT = f"""{ST}, lagged AS (SELECT *, lag(mean) OVER (PARTITION BY {STAR} ORDER BY timestamp) AS prev FROM stats),
 sums AS (SELECT *, regr_count(mean, prev) OVER f AS n, regr_avgx(mean, prev) OVER f AS xbar, regr_avgy(mean, prev) OVER f AS ybar,
   regr_sxx(mean, prev) OVER f AS sxx, regr_syy(mean, prev) OVER f AS syy, regr_sxy(mean, prev) OVER f AS sxy
   FROM lagged WINDOW f AS (PARTITION BY {STAR} ORDER BY timestamp ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)),
 slope AS (SELECT *, sxy / sxx AS phi, ybar - sxy / sxx * xbar AS c FROM sums WHERE n >= 19 AND sxx > 0),
 fit AS (SELECT *, greatest(syy - phi * sxy, 0) / (n - 2) AS sigma2 FROM slope)"""
FC = f"""{FIT}, tq(df, t) AS (VALUES {T_VALUES}),
 steps AS (SELECT f.*, 1 AS horizon, 1.0 AS s, 0.0 AS ds, 1.0 AS vs, 1.0 AS ph, phi AS pw FROM fit f
   UNION ALL SELECT f.*, 2, 1 + phi, 1.0, 1 + phi*phi, phi, phi*phi FROM fit f
   UNION ALL SELECT f.*, 3, 1 + phi + phi*phi, 1 + 2*phi, 1 + phi*phi + phi*phi*phi*phi, phi*phi, phi*phi*phi FROM fit f),
 parts AS (SELECT *, c*s + pw*mean AS point, c*ds + horizon*ph*mean AS g1 FROM steps),
 vars AS (SELECT *, sigma2 * (vs + s*s/n + (g1 - s*xbar)*(g1 - s*xbar)/sxx) AS var FROM parts),
 pred AS (SELECT station, sensor, timestamp AS origin_ts, mean AS origin_value, horizon, timestamp + horizon * {HOUR} AS timestamp, point,
   point - t * sqrt(var) AS lower, point + t * sqrt(var) AS upper FROM vars JOIN tq ON tq.df = n - 2)"""
SC = f"""{FC}, scored AS (SELECT p.station, p.sensor, p.horizon, p.timestamp, s.mean AS actual, p.point, p.lower, p.upper, abs(s.mean - p.point) AS abs_error,
   abs(s.mean - p.origin_value) AS naive_error, s.mean BETWEEN p.lower AND p.upper AS covered
   FROM pred p JOIN stats s ON s.station = p.station AND s.sensor = p.sensor AND s.timestamp = p.timestamp WHERE p.horizon IN (1, 3))"""
MS = f"""{SC}, measured AS (SELECT *, count(*) OVER w AS n, avg(abs_error) OVER w AS mae, sum(abs_error) OVER w / nullif(sum(naive_error) OVER w, 0) AS mase,
   avg(CAST(covered AS INTEGER)) OVER w AS coverage
   FROM scored WINDOW w AS (PARTITION BY {STAR}, horizon ORDER BY timestamp ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""
ASOF = f"""{MS}, origins AS (SELECT DISTINCT station, sensor, origin_ts, h AS horizon FROM pred, (VALUES (1), (3)) t(h)),
 known AS (SELECT o.station, o.sensor, o.origin_ts, o.horizon, coalesce(m.n, 0) AS n, m.mae, m.mase, m.coverage
   FROM origins o ASOF LEFT JOIN measured m ON m.station = o.station AND m.sensor = o.sensor AND m.horizon = o.horizon AND m.timestamp <= o.origin_ts)"""
NEWEST = f"""{ASOF}, newest AS (SELECT station, sensor, mase, coverage FROM (SELECT *, row_number() OVER (PARTITION BY {STAR} ORDER BY origin_ts DESC) AS r FROM known WHERE horizon = 1) WHERE r = 1)"""
MISS = f"""{SC}, one AS (SELECT *, sum(CAST(covered AS INTEGER)) OVER (PARTITION BY {STAR} ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS island FROM scored WHERE horizon = 1),
 missed AS (SELECT *, sum(CASE WHEN covered THEN 0 ELSE 1 END) OVER (PARTITION BY {STAR}, island ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS misses FROM one),
 judged AS (SELECT *, misses > 0 AND upper > lower AND (CASE WHEN actual > upper THEN actual - upper ELSE lower - actual END) > (upper - lower) / 2 AS extreme FROM missed)"""
STATES = f"""{RAW}, states AS (SELECT station, timestamp, event_id AS seq, regime AS truth, (regime + 1 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) % 3 AS state FROM raw)"""


def confusion(last: int) -> str:
    cells = ", ".join(f"sum(CASE WHEN state = {i} AND truth = {j} THEN 1 ELSE 0 END) OVER w AS c{i}{j}" for i in range(3) for j in range(3))
    return f"""{STATES}, conf AS (SELECT *, count(*) OVER w AS n_scored, {cells} FROM states
      WINDOW w AS (PARTITION BY station ORDER BY seq ROWS BETWEEN {last - 1} PRECEDING AND CURRENT ROW)),
     acc AS (SELECT *, greatest(c00+c11+c22, c00+c12+c21, c01+c10+c22, c01+c12+c20, c02+c10+c21, c02+c11+c20) AS matched FROM conf)"""


def flips(src: str, key: str, order: str, fire: str, recover: str) -> str:
    """Rows of src where the held state changes."""
    return f"""held AS (SELECT *, coalesce(last_value(CASE WHEN {fire} THEN 1 WHEN {recover} THEN 0 END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING), 0) AS s FROM {src}),
     flips AS (SELECT * FROM (SELECT *, lag(s, 1, 0) OVER (PARTITION BY {key} ORDER BY {order}) AS p FROM held) WHERE s <> p)"""


LOG = f"""{RAW}, picked AS (SELECT *, ['anomaly','calibration','model_degraded','regime_change','regime_accuracy'][event_id // 7 % 5 + 1] AS rule FROM raw),
 log AS (SELECT event_id AS seq, station, CAST(CASE WHEN rule IN ('regime_change','regime_accuracy') THEN NULL ELSE event_id % 2 END AS INTEGER) AS sensor, timestamp, rule,
   CASE WHEN rule IN ('calibration','model_degraded','regime_accuracy') AND event_id % 3 = 0 THEN 'resolved' ELSE 'firing' END AS state,
   CASE WHEN rule IN ('calibration','model_degraded','regime_accuracy') AND event_id % 3 = 0 THEN 'info' WHEN rule = 'calibration' THEN 'serious' ELSE 'warning' END AS severity FROM picked),
 active AS (SELECT seq, station, sensor, timestamp, rule, state, severity FROM (SELECT *, row_number() OVER (PARTITION BY rule, station, sensor ORDER BY seq DESC) AS r FROM log
    WHERE timestamp <= {NOW} AND rule IN ('calibration','model_degraded','regime_accuracy')) WHERE r = 1 AND state = 'firing'
   UNION ALL SELECT * FROM log WHERE timestamp <= {NOW} AND rule IN ('anomaly','regime_change') AND {NOW} - timestamp <= {6 * HOUR})"""
BUCKETS = f"""lat AS (SELECT received // 1000 * 1000 AS second, median(CAST(received - timestamp - window_ms AS DOUBLE)) AS latency FROM arrivals GROUP BY 1),
 buckets AS (SELECT * FROM lat WHERE second < (SELECT max(second) FROM lat))"""
SECTION = "SELECT {by}timestamp, round(avg(mean), 6) AS mean, round(min(mean), 6) AS min, round(max(mean), 6) AS max FROM {src} GROUP BY ALL HAVING count(*) = {n}"


def decimated(agg: str) -> str:
    y = {"mean": "avg(mean)", "min": "min(mean)", "max": "max(mean)", "last": "arg_max(mean, timestamp)"}[agg]
    return f"""WITH {ST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {STAR} ORDER BY timestamp) - 1 AS r, count(*) OVER (PARTITION BY {STAR}) AS n FROM stats)
     SELECT station, sensor, max(timestamp) AS x, round({y}, 6) AS y FROM ranked GROUP BY station, sensor, r // CASE WHEN n <= 50 THEN 1 ELSE CAST(ceil(n / 50.0) AS BIGINT) END"""


NEWER = f"""WITH {DIS}, b AS (SELECT *, max(timestamp) OVER (PARTITION BY station ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM dis)"""

ORACLE_SQL = {
    "raw_view": f"WITH {RAW} SELECT event_id, station, timestamp, v0, v1, regime FROM raw",
    "explode_channels": f"WITH {EX} SELECT event_id, station, sensor, timestamp, value FROM ex",
    "nonfinite_filter": f"""WITH {EX}, bad AS (SELECT station, sensor, sensor = 0 AND (event_id % 97 = 0 OR event_id % 101 = 0) AS b FROM ex)
      SELECT station, sensor, count(*) FILTER (b) AS dropped, count(*) FILTER (NOT b) AS kept FROM bad GROUP BY ALL""",
    "window_alignment": f"""WITH {RAW}, s AS (SELECT event_id, timestamp - {NOW} AS t FROM raw)
      SELECT event_id, t, {floor_to('t')} AS start, CAST(floor((t - 1) / 500.0) AS BIGINT) * 500 + 501 AS tick FROM s""",
    "station_fanout": "SELECT 'Station' || chr(CAST(i + 65 AS INTEGER)) AS station, CAST(i + 7 AS BIGINT) AS seed FROM range(26) t(i)",
    "station_token": "SELECT c_name AS name, regexp_full_match(c_name, '[A-Za-z0-9_-]+') AS ok, regexp_full_match(c_name || '.x', '[A-Za-z0-9_-]+') AS dotted FROM customer",
    "quarantine_split": f"""WITH {RAW} SELECT event_id, event_id % 50 <> 0 AS ok, CASE WHEN event_id % 50 <> 0 THEN station END AS station,
      CASE WHEN event_id % 50 <> 0 THEN timestamp END AS timestamp, CASE WHEN event_id % 50 <> 0 THEN regime END AS regime FROM raw""",
    "to_json_contract": f"""WITH {ST} SELECT '{{"station":"' || station || '","sensor":' || sensor || ',"timestamp":' || timestamp || ',"window_ms":' || window_ms || ',"count":' || count ||
      CASE WHEN regime > 0 THEN ',"regime":' || regime ELSE '' END || '}}' AS value FROM stats""",
    "log_replay": f"WITH {RAW} SELECT station, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM raw WHERE timestamp BETWEEN {NOW} AND {NOW + DAY} GROUP BY 1",
    "narrowing_casts": f"""WITH {ST} SELECT station, count(*) AS n, timestamp % {5 * HOUR} <> 0 AND timestamp % {7 * HOUR} <> 0 AS kept FROM stats GROUP BY ALL""",
    "clock_format": f"WITH {RAW} SELECT event_id, strftime(make_timestamp((timestamp + {330 * 60_000}) * 1000), '%H:%M:%S') AS clock FROM raw",
    "rounding": f"WITH {RAW} SELECT event_id, round(v0, 2) AS r2, round(v0 / 7, 6) AS r6 FROM raw",
    "affine": f"WITH {RAW} SELECT event_id, round((v0 - 10.0) / 4.0, 6) AS y FROM raw",
    "tumbling_stats": f"WITH {EX}, win AS ({windows_of('ex')}) SELECT station, sensor, timestamp, count, round(mean, 6) AS mean, min, max FROM win",
    "tumbling_finite": f"""WITH {EX}, fin AS (SELECT * FROM ex WHERE NOT (sensor = 0 AND (event_id % 97 = 0 OR event_id % 101 = 0))), win AS ({windows_of('fin')})
      SELECT station, sensor, timestamp, count, round(mean, 6) AS mean, min, max FROM win""",
    "majority_regime": f"WITH {RAW} {majority_of('raw')}",
    "stats_with_regime": f"WITH {ST} SELECT * REPLACE (round(mean, 6) AS mean) FROM stats",
    "bulk_windows": f"""WITH li AS (SELECT l_returnflag AS station, epoch_us(l_shipdate) // 1000 AS timestamp, l_quantity, l_extendedprice FROM lineitem),
      ex AS (SELECT station, timestamp, 0 AS sensor, l_quantity AS value FROM li UNION ALL SELECT station, timestamp, 1, l_extendedprice FROM li), win AS ({windows_of('ex', DAY)})
      SELECT station, sensor, timestamp, count, round(mean, 6) AS mean, min, max FROM win""",
    "late_events": f"WITH {MARK} SELECT event_id, station, timestamp, late FROM marked",
    "late_by_global_bound": f"WITH {MARK} SELECT station, count(*) FILTER (late_all) AS late, count(*) AS n FROM marked GROUP BY 1",
    "on_time_stats": f"""WITH {MARK}, ok AS (SELECT * FROM marked WHERE NOT late), ex AS (SELECT station, timestamp, 0 AS sensor, v0 AS value FROM ok UNION ALL SELECT station, timestamp, 1, v1 FROM ok),
      win AS ({windows_of('ex')}), maj AS ({majority_of('ok')})
      SELECT station, sensor, timestamp, CAST({HOUR} AS BIGINT) AS window_ms, round(mean, 6) AS mean, min, max, count, regime FROM win JOIN maj USING (station, timestamp)""",
    "running_max": f"{NEWER} SELECT event_id, before FROM b",
    "open_windows": f"""WITH {RAW}, m AS (SELECT station, max(timestamp) AS max_ts FROM raw GROUP BY 1)
      SELECT DISTINCT station, {floor_to('timestamp')} AS timestamp, max_ts FROM raw JOIN m USING (station) WHERE {floor_to('timestamp')} + {HOUR} > max_ts - {LATE}""",
    "idle_close": f"""WITH {RAW}, r AS (SELECT * FROM raw WHERE timestamp < {NOW} - length(station) * {HOUR} / 4.0), m AS (SELECT station, max(timestamp) AS max_ts FROM r GROUP BY 1)
      SELECT DISTINCT station, {floor_to('timestamp')} AS timestamp, max_ts FROM r JOIN m USING (station) WHERE {floor_to('timestamp')} + {HOUR} > max_ts - {LATE} AND {NOW} - max_ts > {2 * HOUR}""",
    "strictly_newer": f"{NEWER} SELECT event_id, station, timestamp FROM b WHERE before IS NULL OR timestamp > before",
    "dedup_first_wins": f"WITH {RAW} SELECT event_id, station, timestamp, 0 AS copy FROM raw",
    "upsert_antijoin": f"WITH {ST} SELECT station, sensor, timestamp, round(mean, 6) AS mean, count FROM stats WHERE timestamp % {2 * HOUR} <> 0",
    "missing_keys": f"WITH {ST} SELECT station, sensor, timestamp FROM stats EXCEPT SELECT station, sensor, timestamp FROM stats WHERE timestamp % {3 * HOUR} <> 0",
    "latest_n": f"WITH {ST} SELECT * REPLACE (round(mean, 6) AS mean) FROM stats ORDER BY timestamp DESC, station, sensor LIMIT 100",
    "range_query": f"""WITH {ST} SELECT * REPLACE (round(mean, 6) AS mean) FROM stats WHERE station = 'click' AND sensor = 1 AND timestamp BETWEEN {NOW - 3 * DAY} AND {NOW}
      ORDER BY timestamp DESC LIMIT 50""",
    "backfill_union": f"""WITH {ST}, live AS (SELECT station, sensor, timestamp, round(mean, 6) AS mean, 'live' AS origin FROM stats WHERE timestamp >= {NOW}),
      room AS (SELECT station, sensor, min(timestamp) AS f, count(*) AS n FROM live GROUP BY ALL),
      old AS (SELECT s.station, s.sensor, s.timestamp, round(s.mean, 6) AS mean, 'archive' AS origin, row_number() OVER (PARTITION BY s.station, s.sensor ORDER BY s.timestamp DESC) AS r, coalesce(n, 0) AS n
        FROM stats s LEFT JOIN room USING (station, sensor) WHERE f IS NULL OR s.timestamp < f)
      SELECT * FROM live UNION ALL SELECT station, sensor, timestamp, mean, origin FROM old WHERE r <= 500 - n""",
    "lag_diff": f"WITH {ST} SELECT station, sensor, timestamp, round(mean - lag(mean) OVER (PARTITION BY {STAR} ORDER BY timestamp), 6) AS diff FROM stats",
    "ar1_params": f"WITH {FIT} SELECT station, sensor, timestamp, n, round(phi, 6) AS phi, round(c, 4) AS c, round(sigma2, 3) AS sigma2 FROM fit",
    "forecast_points": f"WITH {FC} SELECT station, sensor, origin_ts, horizon, timestamp, round(point, 4) AS point FROM pred",
    "forecast_intervals": f"WITH {FC} SELECT station, sensor, origin_ts, horizon, round(lower, 4) AS lower, round(upper, 4) AS upper FROM pred",
    "forecast_messages": f"""WITH {FC} SELECT station, sensor, origin_ts, count(*) AS steps, min(timestamp) AS first_ts, round(max(point) FILTER (horizon = 1), 4) AS one_step,
      CAST(0.98 AS DOUBLE) AS confidence FROM pred GROUP BY station, sensor, origin_ts""",
    "forecast_long_form": f"WITH {FC} SELECT station, sensor, origin_ts, horizon, timestamp, round(point, 4) AS point FROM pred",
    "forecast_scores": f"WITH {SC} SELECT station, sensor, horizon, timestamp, round(abs_error, 4) AS abs_error, round(naive_error, 6) AS naive_error, covered FROM scored",
    "rolling_mae": f"WITH {MS} SELECT station, sensor, horizon, timestamp, n, round(mae, 4) AS mae FROM measured",
    "rolling_mase": f"WITH {MS} SELECT station, sensor, horizon, timestamp, round(mase, 4) AS mase FROM measured",
    "rolling_coverage": f"WITH {MS} SELECT station, sensor, horizon, timestamp, round(coverage, 6) AS coverage FROM measured",
    "metrics_asof": f"WITH {ASOF} SELECT station, sensor, origin_ts, horizon, n, round(mae, 4) AS mae, round(coverage, 6) AS coverage FROM known",
    "metric_history": f"WITH {ASOF} SELECT station, sensor, origin_ts, horizon, round(mase, 4) AS mase FROM known WHERE n >= 20",
    "newest_horizon": f"""WITH {FC} SELECT station, sensor, origin_ts, horizon, timestamp, round(point, 4) AS point FROM pred
      QUALIFY origin_ts = max(origin_ts) OVER (PARTITION BY {STAR})""",
    "miss_runs": f"WITH {MISS} SELECT station, sensor, timestamp, CAST(misses AS BIGINT) AS misses FROM judged",
    "anomaly_candidates": f"""WITH {MISS} SELECT station, sensor, timestamp, extreme, CASE WHEN extreme THEN 'serious' ELSE 'warning' END AS severity, CAST(misses AS BIGINT) AS misses
      FROM judged WHERE extreme OR misses >= 2""",
    "anomaly_cooldown": f"""WITH RECURSIVE {MISS}, cand AS MATERIALIZED (SELECT station, sensor, timestamp FROM judged WHERE extreme OR misses >= 1),
      succ AS MATERIALIZED (SELECT a.station, a.sensor, a.timestamp, min(b.timestamp) AS later FROM cand a LEFT JOIN cand b ON a.station = b.station AND a.sensor = b.sensor
        AND b.timestamp >= a.timestamp + {36 * HOUR} GROUP BY ALL),
      fired AS (SELECT station, sensor, min(timestamp) AS timestamp FROM cand GROUP BY ALL
        UNION ALL SELECT f.station, f.sensor, s.later FROM fired f JOIN succ s ON s.station = f.station AND s.sensor = f.sensor AND s.timestamp = f.timestamp WHERE s.later IS NOT NULL)
      SELECT station, sensor, timestamp FROM fired""",
    "anomaly_messages": f"""WITH {MISS} SELECT 'anomaly:' || station || ':' || sensor || ':' || timestamp AS id, 'anomaly' AS rule, CASE WHEN extreme THEN 'serious' ELSE 'warning' END AS severity,
      'firing' AS state, round(actual, 6) AS value FROM judged WHERE extreme OR misses >= 2""",
    "calibration_hysteresis": f"""WITH {MS}, one1 AS (SELECT * FROM measured WHERE horizon = 1), {flips('one1', STAR, 'timestamp', 'n >= 100 AND coverage < 0.975', 'n >= 100 AND coverage >= 0.985')}
      SELECT station, sensor, timestamp, CASE WHEN s = 1 THEN 'firing' ELSE 'resolved' END AS state, round(coverage, 6) AS coverage FROM flips""",
    "degraded_hysteresis": f"""WITH {MS}, one1 AS (SELECT * FROM measured WHERE horizon = 1), {flips('one1', STAR, 'timestamp', 'n >= 100 AND mase > 0.74', 'n >= 100 AND mase <= 0.735')}
      SELECT station, sensor, timestamp, CASE WHEN s = 1 THEN 'firing' ELSE 'resolved' END AS state, round(mase, 4) AS mase FROM flips""",
    "regime_change_runs": f"""WITH {RAW}, ch AS (SELECT station, event_id AS seq, timestamp, regime AS state, CASE WHEN regime = lag(regime) OVER w THEN 0 ELSE 1 END AS c FROM raw WINDOW w AS (PARTITION BY station ORDER BY event_id)),
      isl AS (SELECT *, sum(c) OVER (PARTITION BY station ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i FROM ch),
      held AS (SELECT *, row_number() OVER (PARTITION BY station, i ORDER BY seq) AS r FROM isl),
      conf AS (SELECT *, lag(state) OVER (PARTITION BY station ORDER BY seq) AS previous FROM held WHERE r = 4)
      SELECT station, seq, timestamp, previous, state FROM conf WHERE previous <> state""",
    "confusion_rolling": f"WITH {confusion(300)} SELECT station, seq, n_scored, " + ", ".join(f"CAST(c{i}{j} AS BIGINT) AS c{i}{j}" for i in range(3) for j in range(3)) + " FROM conf",
    "best_permutation_accuracy": f"WITH {confusion(300)} SELECT station, seq, CAST(matched AS BIGINT) AS matched, round(matched / n_scored, 6) AS accuracy FROM acc",
    "accuracy_sustained": f"""WITH {confusion(200)}, ok AS (SELECT *, matched / n_scored AS accuracy FROM acc WHERE n_scored >= 100),
      isl AS (SELECT *, sum(CASE WHEN accuracy < 0.80 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i FROM ok),
      since AS (SELECT *, min(CASE WHEN accuracy < 0.80 THEN timestamp END) OVER (PARTITION BY station, i ORDER BY seq ROWS UNBOUNDED PRECEDING) AS since FROM isl),
      {flips('since', 'station', 'seq', f'accuracy < 0.80 AND timestamp - since >= {4 * HOUR}', 'accuracy >= 0.81')}
      SELECT station, seq, timestamp, CASE WHEN s = 1 THEN 'firing' ELSE 'resolved' END AS state, round(accuracy, 6) AS accuracy FROM flips""",
    "stateful_messages": f"""WITH {MS}, one1 AS (SELECT * FROM measured WHERE horizon = 1), {flips('one1', STAR, 'timestamp', 'n >= 100 AND coverage < 0.975', 'n >= 100 AND coverage >= 0.985')},
      {flips('one1', STAR, 'timestamp', 'n >= 100 AND mase > 0.74', 'n >= 100 AND mase <= 0.735').replace('held', 'held2').replace('flips', 'flips2')},
      {confusion(200).replace(RAW + ', ', '')}, ok AS (SELECT *, matched / n_scored AS accuracy FROM acc WHERE n_scored >= 100),
      isl AS (SELECT *, sum(CASE WHEN accuracy < 0.80 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i FROM ok),
      since AS (SELECT *, min(CASE WHEN accuracy < 0.80 THEN timestamp END) OVER (PARTITION BY station, i ORDER BY seq ROWS UNBOUNDED PRECEDING) AS since FROM isl),
      {flips('since', 'station', 'seq', f'accuracy < 0.80 AND timestamp - since >= {4 * HOUR}', 'accuracy >= 0.81').replace('held', 'held3').replace('flips', 'flips3')},
      told AS (SELECT 'calibration' AS rule, station, CAST(sensor AS INTEGER) AS sensor, CAST(sensor AS VARCHAR) AS part, timestamp, s, coverage AS value, 'serious' AS level,
          'Interval coverage ' || printf('%.1f', coverage * 100) || '% below 98%' AS fired, 'Interval coverage recovered to ' || printf('%.1f', coverage * 100) || '%' AS ok FROM flips
        UNION ALL SELECT 'model_degraded', station, CAST(sensor AS INTEGER), CAST(sensor AS VARCHAR), timestamp, s, mase, 'warning', 'MASE ' || printf('%.2f', mase) || ': forecasts worse than naive persistence', 'MASE recovered to ' || printf('%.2f', mase) FROM flips2
        UNION ALL SELECT 'regime_accuracy', station, NULL, '-1', timestamp, s, accuracy, 'warning', 'Regime detection accuracy ' || printf('%.0f', accuracy * 100) || '% below 80% for 14400 s', 'Regime detection accuracy recovered to ' || printf('%.0f', accuracy * 100) || '%' FROM flips3)
      SELECT rule || ':' || station || ':' || part || ':' || timestamp AS id, rule, CASE WHEN s = 1 THEN level ELSE 'info' END AS severity, CASE WHEN s = 1 THEN 'firing' ELSE 'resolved' END AS state,
        station, sensor, timestamp, CASE WHEN s = 1 THEN fired ELSE ok END AS message, round(value, 4) AS value FROM told""",
    "regime_change_messages": f"""WITH {RAW}, ch AS (SELECT station, event_id AS seq, timestamp, regime AS state, CASE WHEN regime = lag(regime) OVER w THEN 0 ELSE 1 END AS c FROM raw WINDOW w AS (PARTITION BY station ORDER BY event_id)),
      isl AS (SELECT *, sum(c) OVER (PARTITION BY station ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i FROM ch),
      held AS (SELECT *, row_number() OVER (PARTITION BY station, i ORDER BY seq) AS r FROM isl),
      conf AS (SELECT *, lag(state) OVER (PARTITION BY station ORDER BY seq) AS previous FROM held WHERE r = 4)
      SELECT 'regime_change:' || station || ':' || timestamp AS id, 'regime_change' AS rule, 'info' AS severity, 'firing' AS state, station, CAST(NULL AS INTEGER) AS sensor, timestamp,
        'Regime change detected: R' || previous || ' → R' || state AS message, CAST(state AS DOUBLE) AS value FROM conf WHERE previous <> state""",
    "derived_messages": f"""WITH {ARR}, r AS (SELECT station, sensor, max(received) AS last_received FROM arrivals WHERE received < {NOW} - length(station) * window_ms GROUP BY ALL),
      late AS (SELECT station, timestamp, window_ms, received + 150 AS received FROM arrivals),
      lat AS (SELECT received // 1000 * 1000 AS second, median(CAST(received - timestamp - window_ms AS DOUBLE)) AS latency FROM late GROUP BY 1),
      buckets AS (SELECT * FROM lat WHERE second < (SELECT max(second) FROM lat)),
      recent AS (SELECT * FROM buckets ORDER BY second DESC LIMIT 30), g AS (SELECT count(*) AS n, min(latency) AS lo, max(latency) AS peak, max(second) AS timestamp FROM recent)
      SELECT 'stale:' || station || ':' || sensor AS id, 'stale' AS rule, 'critical' AS severity, 'firing' AS state, station, CAST(sensor AS INTEGER) AS sensor, last_received AS timestamp,
        'No new window for ' || printf('%.0f', ({NOW} - last_received) / 1000.0) || ' s' AS message, CAST(NULL AS DOUBLE) AS value FROM r WHERE {NOW} - last_received > {6 * HOUR}
      UNION ALL SELECT DISTINCT 'latency:' || station, 'latency', 'warning', 'firing', station, CAST(NULL AS INTEGER), g.timestamp,
        'Pipeline latency above 100 ms for 30 s (peak ' || printf('%.0f', peak) || ' ms)', CAST(NULL AS DOUBLE) FROM stats, g WHERE n = 30 AND lo > 100""",
    "active_alerts": f"WITH {LOG} SELECT * FROM active",
    "alert_feed": f"""WITH {LOG} SELECT * FROM log WHERE station IN ('click', 'view', 'purchase') AND (sensor IS NULL OR (station = 'click' AND sensor = 0) OR (station = 'view' AND sensor = 1))
      ORDER BY seq DESC LIMIT 25""",
    "alert_counts": f"WITH {LOG} SELECT station, sensor, count(*) AS n, count(*) FILTER (severity IN ('serious', 'critical')) AS severe FROM log GROUP BY ALL",
    "stale_series": f"""WITH {ARR}, r AS (SELECT station, sensor, max(received) AS last_received FROM arrivals WHERE received < {NOW} - length(station) * window_ms GROUP BY ALL)
      SELECT station, sensor, last_received FROM r WHERE {NOW} - last_received > {6 * HOUR}""",
    "latency_buckets": f"WITH {ARR}, {BUCKETS} SELECT second, latency FROM buckets",
    "latency_sustained": f"""WITH {ST}, arrivals AS (SELECT *, timestamp + window_ms + (timestamp // {HOUR}) * 37 % 400 + sensor * 3 + 150 AS received FROM stats), {BUCKETS},
      recent AS (SELECT * FROM buckets ORDER BY second DESC LIMIT 30), g AS (SELECT count(*) AS n, min(latency) AS lo, max(latency) AS peak, max(second) AS timestamp FROM recent)
      SELECT DISTINCT station, g.timestamp, peak FROM stats, g WHERE n = 30 AND lo > 100""",
    "median_latency": f"""WITH {ARR}, r AS (SELECT CAST(received - timestamp - window_ms AS DOUBLE) AS l FROM arrivals ORDER BY received DESC, timestamp DESC, station, sensor LIMIT 500)
      SELECT median(l) AS latency_ms_p50, count(*) AS n FROM r""",
    "throughput_trailing": f"""WITH {RAW} SELECT event_id, round(count(*) OVER (ORDER BY timestamp RANGE BETWEEN {10 * HOUR} PRECEDING AND CURRENT ROW) / {10 * HOUR / 1000.0}, 9) AS per_second FROM raw""",
    "counter_rate": f"""WITH {RAW}, c AS (SELECT station, timestamp, event_id % 1000 AS v, lag(event_id % 1000) OVER (PARTITION BY station ORDER BY event_id) AS p FROM raw)
      SELECT station, {floor_to('timestamp', DAY)} AS bucket, round(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END) / {DAY / 1000.0}, 9) AS rate FROM c GROUP BY ALL""",
    "histogram_quantile": f"""WITH {RAW}, le(le) AS (VALUES (5.0::DOUBLE), (10), (25), (50), (100), (250), ('inf'::DOUBLE)), n AS (SELECT station, le, count(*) FILTER (v0 <= le) AS n FROM raw, le GROUP BY ALL),
      b AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, 0.95 * max(n) OVER (PARTITION BY station) AS rank FROM n WINDOW w AS (PARTITION BY station ORDER BY le)),
      f AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY le) AS r FROM b WHERE n >= rank)
      SELECT station, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - below) / nullif(n - below, 0) END, 6) AS quantile FROM f WHERE r = 1""",
    "dashboard_aggregates": f"""WITH {RAW} SELECT {floor_to('timestamp', DAY)} AS day, round(sum(v0), 4) AS total, round(avg(v0), 6) AS mean, max(v0) AS most,
      round(quantile_cont(v0, 0.5), 6) AS p50, round(quantile_cont(v0, 0.99), 6) AS p99 FROM raw GROUP BY 1""",
    "cross_section": f"WITH {ST}, z AS (SELECT * FROM stats WHERE sensor = 0) " + SECTION.format(by="", src="z", n="(SELECT count(DISTINCT station) FROM z)"),
    "station_section": f"WITH {ST} " + SECTION.format(by="station, ", src="stats", n=2),
    "aligned_metric_mean": f"""WITH {MS}, z AS (SELECT * FROM measured WHERE horizon = 1 AND sensor = 0 AND mase IS NOT NULL)
      SELECT timestamp, round(avg(mase), 4) AS mean FROM z GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT station) FROM z)""",
    "change_correlation": f"""WITH {ST}, p AS (SELECT a.timestamp, a.station AS station_a, a.sensor AS sensor_a, b.station AS station_b, b.sensor AS sensor_b, a.mean AS a, b.mean AS b
        FROM stats a JOIN stats b ON a.timestamp = b.timestamp WHERE (a.station, a.sensor) <= (b.station, b.sensor)),
      q AS (SELECT *, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM p WINDOW w AS (PARTITION BY station_a, sensor_a, station_b, sensor_b ORDER BY timestamp)),
      g AS (SELECT station_a, sensor_a, station_b, sensor_b, count(*) AS common, covar_pop(da, db) AS cov, stddev_pop(da) AS sa, stddev_pop(db) AS sb FROM q GROUP BY ALL)
      SELECT station_a, sensor_a, station_b, sensor_b, common, CASE WHEN common >= 21 AND sa >= 1e-12 AND sb >= 1e-12 THEN round(cov / (sa * sb), 2) END AS r FROM g""",
    "zscore_params": f"WITH {ST} SELECT station, sensor, round(avg(mean), 6) AS a, round(CASE WHEN stddev_pop(mean) > 1e-12 THEN stddev_pop(mean) ELSE 1 END, 6) AS b FROM stats GROUP BY ALL",
    "zscore_compare": f"""WITH {ST}, g AS (SELECT station, sensor, avg(mean) AS a, CASE WHEN stddev_pop(mean) > 1e-12 THEN stddev_pop(mean) ELSE 1 END AS b FROM stats GROUP BY ALL)
      SELECT station, sensor, timestamp, round((mean - a) / b, 5) AS z FROM stats JOIN g USING (station, sensor)""",
    **{f"decimate_{a}": decimated(a) for a in ("mean", "min", "max", "last")},
    "keep_last_n": f"WITH {ST} SELECT station, sensor, timestamp, round(mean, 6) AS mean FROM stats QUALIFY row_number() OVER (PARTITION BY {STAR} ORDER BY timestamp DESC) <= 60",
    "every_nth": f"WITH {RAW} SELECT event_id, station, timestamp FROM raw QUALIFY row_number() OVER (PARTITION BY station ORDER BY event_id) % 5 = 0",
    "median_spacing": f"""WITH {ST}, l AS (SELECT *, row_number() OVER (PARTITION BY {STAR} ORDER BY timestamp DESC) AS r FROM stats),
      g AS (SELECT station, sensor, timestamp - lag(timestamp) OVER (PARTITION BY {STAR} ORDER BY timestamp) AS g FROM l WHERE r <= 21), o AS (SELECT station, sensor, list_sort(list(g) FILTER (g > 0)) AS g FROM g GROUP BY ALL)
      SELECT station, sensor, coalesce(g[len(g) // 2 + 1], {HOUR}) AS spacing FROM o""",
    "selection": f"WITH {ST} SELECT station, sensor, timestamp, count FROM stats WHERE station IN ('click', 'view') AND sensor = 0 AND timestamp >= {NOW}",
    "distinct_series": f"WITH {ST} SELECT station, count(DISTINCT sensor) AS sensors, min(sensor) AS least, max(sensor) AS most, count(*) AS n FROM stats GROUP BY 1",
    "health_grid": f"WITH {NEWEST} SELECT station, round(max(mase) FILTER (sensor = 0), 4) AS s0, round(max(mase) FILTER (sensor = 1), 4) AS s1 FROM newest GROUP BY 1",
    "kpi_tiles": f"""WITH {NEWEST}, {LOG.replace(RAW + ', ', '')}, arrivals AS (SELECT *, timestamp + window_ms + (timestamp // {HOUR}) * 37 % 400 + sensor * 3 AS received FROM stats),
      r AS (SELECT CAST(received - timestamp - window_ms AS DOUBLE) AS l FROM arrivals ORDER BY received DESC, timestamp DESC, station, sensor LIMIT 500)
      SELECT (SELECT round(avg(mase), 4) FROM newest) AS mase, (SELECT round(avg(coverage), 6) FROM newest) AS coverage, (SELECT count(*) FROM active) AS active,
       (SELECT count(*) FROM active WHERE severity IN ('serious', 'critical')) AS severe, (SELECT median(l) FROM r) AS latency_ms_p50""",
    "delta_since_cursor": f"""WITH {ST}, c AS (SELECT station, sensor, max(timestamp) - {2 * DAY} AS cursor FROM stats WHERE sensor = 0 GROUP BY ALL),
      n AS (SELECT station, sensor, timestamp, mean, row_number() OVER (PARTITION BY station, sensor ORDER BY timestamp DESC) AS r FROM stats LEFT JOIN c USING (station, sensor) WHERE cursor IS NULL OR timestamp > cursor)
      SELECT station, sensor, timestamp, round(mean, 6) AS mean FROM n WHERE r <= 25""",
    "view_signature": f"WITH {ST} SELECT station, sensor, sha1(station || '|' || sensor || '|' || count(*) || '|' || max(timestamp)) AS digest FROM stats GROUP BY station, sensor",
    "argmax_state": f"""WITH {RAW} SELECT event_id, CASE WHEN event_id % 7 >= event_id % 5 AND event_id % 7 >= event_id % 3 THEN 0 WHEN event_id % 5 >= event_id % 3 THEN 1 ELSE 2 END AS state FROM raw""",
    "series_detail": f"""WITH {FC} SELECT s.timestamp, round(s.mean, 6) AS actual, round(p.point, 4) AS point, round(p.lower, 4) AS lower, round(p.upper, 4) AS upper
      FROM stats s LEFT JOIN pred p ON p.station = s.station AND p.sensor = s.sensor AND p.timestamp = s.timestamp AND p.horizon = 1 WHERE s.station = 'click' AND s.sensor = 0""",
    "moving_average": f"WITH {RAW} SELECT event_id, round(sum(v0) OVER (PARTITION BY station ORDER BY event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25.0, 6) AS ma FROM raw",
    "state_lookup": f"""WITH {RAW}, n AS (SELECT station, row_number() OVER (PARTITION BY station ORDER BY event_id) AS r FROM raw)
      SELECT station, r, CASE WHEN r > 1201 THEN 1201 + (r - 1202) // 600 * 600 END AS fitted_at FROM n""",
}
