"""Forecasts, alerts, regimes and the simulator against sequential models and known statistics."""

import random

import numpy as np
import pytest

from gaugeflow.functions.student import t_quantile
from gaugeflow.operators import alerts, forecast, regime, views
from gaugeflow.sources import simulator

STATS = "station string, sensor int, timestamp long, window_ms long, mean double"


def series(spark, values, station="A"):
    return spark.createDataFrame([(station, 0, i * 500, 500, float(v)) for i, v in enumerate(values)], STATS)


def ar1(n, phi=0.8, sigma=0.1, seed=0):
    rng, x = np.random.default_rng(seed), [0.0]
    for _ in range(n - 1):
        x.append(phi * x[-1] + sigma * rng.standard_normal())
    return np.array(x)


@pytest.mark.parametrize("df,value", [(17, 2.5669339837), (18, 2.5523796302), (28, 2.4671400980), (57, 2.3935675099)])
def test_t_quantile(df, value):
    assert abs(t_quantile(0.99, df) - value) < 1e-9


def test_forecast_is_least_squares_with_its_error(spark):
    x = ar1(60, seed=3) + 5
    got = forecast.forecasts(series(spark, x)).where("origin_ts = 29500").orderBy("horizon").collect()
    a, b = x[:-1], x[1:]
    design = np.stack([np.ones_like(a), a], 1)
    (c, phi), *_ = np.linalg.lstsq(design, b, rcond=None)
    s2 = ((b - c - phi * a) ** 2).sum() / (len(a) - 2)
    cov = s2 * np.linalg.inv(design.T @ design)
    t, point, noise = t_quantile(0.99, len(a) - 2), x[-1], 0.0
    g = np.array([0.0, 0.0])
    for h, row in enumerate(got, 1):
        g = np.array([1.0, point]) + phi * g
        point, noise = c + phi * point, noise + s2 * phi ** (2 * (h - 1))
        half = t * np.sqrt(noise + g @ cov @ g)
        assert np.allclose([row["point"], row["lower"], row["upper"]], [point, point - half, point + half], rtol=1e-9)
    assert got[0]["upper"] - got[0]["lower"] < got[2]["upper"] - got[2]["lower"]


def test_no_forecast_without_twenty_rows_or_variation(spark):
    assert forecast.forecasts(series(spark, ar1(19))).count() == 0
    assert forecast.forecasts(series(spark, ar1(20))).count() == 3
    assert forecast.forecasts(series(spark, [42.0] * 40)).count() == 0


def test_scores_and_metrics(spark):
    rows = series(spark, ar1(120)).cache()
    p = forecast.forecasts(rows)
    m = forecast.rolling_metrics(forecast.scores(p, rows))
    last = {r["horizon"]: r for r in m.where("timestamp = 59500").collect()}
    assert (last[1]["n"], last[3]["n"]) == (100, 98)
    assert last[1]["mase"] < 1
    known = forecast.metrics_asof(p, m)
    first = {r["horizon"]: r["n"] for r in known.where("origin_ts = 9500").collect()}
    assert first == {1: 0, 3: 0}
    gaps = rows.where("timestamp <> 30000")
    assert forecast.scores(forecast.forecasts(gaps), gaps).where("timestamp = 30000").count() == 0


def scored(spark, flags, key="A"):
    return spark.createDataFrame([(key, 0, i * 1000, 0.0 if c else 1.5, -1.0, 1.0, c) for i, c in enumerate(flags)], "station string, sensor int, timestamp long, actual double, lower double, upper double, covered boolean")


def test_runs_and_cooldown_match_a_sequential_model(spark):
    rng = random.Random(1)
    for _ in range(3):
        flags = [rng.random() < 0.6 for _ in range(300)]
        run, want_runs, fired, last = 0, [], [], None
        for i, c in enumerate(flags):
            run = 0 if c else run + 1
            want_runs.append(run)
            if run >= 2 and (last is None or i * 1000 - last >= 10_000):
                last = i * 1000
                fired.append(last)
        df = scored(spark, flags)
        assert [r["misses"] for r in alerts.miss_runs(df).orderBy("timestamp").collect()] == want_runs
        assert [r["timestamp"] for r in alerts.cooled_down(alerts.anomaly_candidates(df)).orderBy("timestamp").collect()] == fired


def test_far_outside_is_serious_at_once(spark):
    df = spark.createDataFrame([("A", 0, 0, 9.0, -1.0, 1.0, False), ("A", 0, 1000, 1.5, -1.0, 1.0, False)], scored(spark, [True]).schema)
    got = alerts.anomaly_candidates(df).orderBy("timestamp").collect()
    assert [r["severity"] for r in got] == ["serious", "warning"]
    assert alerts.anomaly_messages(alerts.cooled_down(alerts.anomaly_candidates(df))).first()["message"] == "Window mean 9.00 outside the forecast interval [-1.00, 1.00]"


def test_hysteresis(spark):
    cov = [(10, 0.5), (150, 0.94), (150, 0.92), (150, 0.94), (150, 0.90), (150, 0.95), (150, 0.99), (150, 0.9)]
    df = spark.createDataFrame([("A", 0, i, n, c) for i, (n, c) in enumerate(cov)], "station string, sensor int, timestamp long, n long, coverage double")
    assert [(r["timestamp"], r["state"]) for r in alerts.calibration(df).orderBy("timestamp").collect()] == [(2, "firing"), (5, "resolved"), (7, "firing")]


def test_regime_change_needs_persistence(spark):
    rng = random.Random(2)
    for persist in (2, 4):
        states = [rng.choice([0, 0, 0, 1, 2]) for _ in range(400)]
        current, cand, count, want = None, None, 0, []
        for i, s in enumerate(states):
            if s == current:
                cand, count = None, 0
                continue
            cand, count = (s, count + 1) if s == cand else (s, 1)
            if count >= persist:
                if current is not None:
                    want.append((i, current, s))
                current, cand, count = s, None, 0
        df = spark.createDataFrame([("A", i, i, s) for i, s in enumerate(states)], "station string, timestamp long, seq long, state int")
        assert [(r["seq"], r["previous"], r["state"]) for r in alerts.regime_changes(df, persist).orderBy("seq").collect()] == want


def test_accuracy_must_stay_low(spark):
    acc = [(0, 0.9, 600), (1000, 0.6, 599), (2000, 0.6, 600), (20_000, 0.71, 600), (21_000, 0.6, 600), (50_000, 0.6, 600), (51_000, 0.6, 600), (52_000, 0.74, 600), (53_000, 0.75, 600)]
    df = spark.createDataFrame([("A", t, i, a, n) for i, (t, a, n) in enumerate(acc)], "station string, timestamp long, seq long, accuracy double, n_scored long")
    assert [(r["timestamp"], r["state"]) for r in alerts.low_accuracy(df).orderBy("seq").collect()] == [(51_000, "firing"), (53_000, "resolved")]


def test_simulator():
    a = simulator.Simulator(4)
    assert np.array_equal(simulator.Simulator(9).steps(50)[0], simulator.Simulator(9).steps(50)[0])
    assert simulator.cholesky(np.array([[1.0, 2.0], [2.0, 1.0]])) is None
    for m, low in zip(a.correlation, a.mix):
        assert np.allclose(low @ low.T, m)
    z = np.random.default_rng(0).standard_normal((200_000, 4)) @ a.mix[0].T
    assert np.abs(np.corrcoef(z.T) - a.correlation[0]).max() < 0.02


def test_regimes_are_found(spark):
    x, truth = simulator.Simulator(0).steps(5000)
    truth = np.concatenate([[0], truth[:-1]])  # the regime that made each sample
    m, _ = regime.fit(x[:2001])
    sigma = np.sqrt(np.trace(m.noise[0], axis1=1, axis2=2) / 4)
    assert np.abs(sigma - sorted(simulator.SIGMA)).max() < 0.02
    assert np.diag(m.step[0]).min() > 0.95
    p = regime.filter_from(m, x[2000:], np.full(3, 1 / 3))
    state = p.argmax(1)
    cells = np.zeros((3, 3), int)
    np.add.at(cells, (state, truth[2001:]), 1)
    from itertools import permutations

    assert max(sum(cells[i, q[i]] for i in range(3)) for q in permutations(range(3))) / len(state) > 0.85


def test_detection_by_segments(spark):
    raw = simulator.simulate(spark, 1, 2000, seed=5)
    got = regime.detect(raw, ["timestamp"]).orderBy("r").collect()
    assert [r["r"] for r in got] == list(range(1202, 2001))
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-5 for r in got)
    assert regime.regime_messages(regime.detect(raw, ["timestamp"])).count() == len(got) // 5


def test_decimation_and_spacing(spark):
    df = series(spark, range(10))
    got = views.decimate(df, ["station", "sensor"], 4, "max").orderBy("x").collect()
    assert [(r["x"], r["y"]) for r in got] == [(1000, 2.0), (2500, 5.0), (4000, 8.0), (4500, 9.0)]
    assert views.decimate(df, ["station", "sensor"], 10, "mean").count() == 10
    assert views.median_spacing(df.limit(1), ["station", "sensor"], 500).first()["spacing"] == 500


def test_correlation_needs_points_and_variation(spark):
    rows = series(spark, range(30)).unionByName(series(spark, ar1(30), "B")).unionByName(series(spark, ar1(10), "C"))
    got = {(r["station_a"], r["station_b"]): r["r"] for r in views.change_correlation(rows).collect()}
    assert got["B", "B"] == 1.0 and got["A", "B"] is None and got["C", "C"] is None


def test_delta_and_backfill(spark):
    df = series(spark, range(20))
    cur = spark.createDataFrame([("A", 0, 5000)], "station string, sensor int, cursor long")
    assert sorted(r["timestamp"] for r in views.delta(df, cur, 2000).collect()) == [7500, 8000, 8500, 9000, 9500]
    live = df.where("timestamp >= 7500")
    got = views.backfill(live, df, 8)
    assert sorted(r["timestamp"] for r in got.where("origin = 'archive'").collect()) == [6000, 6500, 7000]


def test_regime_queries_read_the_whole_table(spark):
    """Every station of the events, a fit at every refit that its rows reach, and each fifth filtered row."""
    from gaugeflow.plans.catalog import QUERIES

    d = "/root/testdata/sf0.01"
    n = {r["event_type"]: r["count"] for r in spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").count().collect()}
    fits = QUERIES["regime_em"](spark, d).collect()
    assert sorted((r["station"], r["fitted_at"]) for r in fits) == sorted((k, at) for k, m in n.items() for at in range(1201, m + 1, 600))
    assert all(np.isfinite(r["loglik"]) and np.isfinite(r["noise"]).all() for r in fits)
    got = QUERIES["hamilton_filter"](spark, d).groupBy("station").count().collect()
    assert {r["station"]: r["count"] for r in got} == {k: (m - 1201) // 5 for k, m in n.items()}


def test_regimes_of_the_simulated_run(spark):
    rows = simulator.simulate(spark, 2, 1900, seed=3)
    assert sorted({r["fitted_at"] for r in regime.fit_segments(rows, ["timestamp"]).collect()}) == [1201, 1801]
    assert regime.regime_messages(regime.detect(rows, ["timestamp"])).count() == 2 * ((1900 - 1201) // 5)
