"""Regimes of many segments fitted together against a plain model, one segment and one step at a time."""

import time

import numpy as np
import pytest

from gaugeflow.operators import regime
from gaugeflow.sources import simulator


def densities(start_of, y, x):
    level, slope, noise = start_of
    gap = y[:, None] - level - slope * x[:, None]
    quad = np.stack([np.einsum("ti,ij,tj->t", gap[:, k], np.linalg.inv(noise[k]), gap[:, k]) for k in range(len(noise))], 1)
    return np.exp(-0.5 * (quad + np.log(np.linalg.det(noise)) + y.shape[1] * np.log(2 * np.pi)))


def maximise(y, x, post, moves):
    level, slope, noise = [], [], []
    for w in post.T:
        n = w.sum() + 1e-12
        b = (n * (w @ (x * y)) - (w @ x) * (w @ y)) / (n * (w @ (x * x)) - (w @ x) ** 2 + regime.RIDGE)
        a = (w @ y - b * (w @ x)) / n
        gap = y - a - b * x
        level.append(a), slope.append(b), noise.append((w[:, None] * gap).T @ gap / n + regime.RIDGE * np.eye(y.shape[1]))
    return post[0] / post[0].sum(), moves / moves.sum(1, keepdims=True), (np.array(level), np.array(slope), np.array(noise))


def plain_fit(levels, k=3):
    """Baum-Welch from each start by itself; the best log-likelihood and the start's noise traces in order."""
    y, x = np.diff(levels, axis=0), levels[:-1]
    t, found = len(y), []
    for width in regime.SMOOTH:
        vol = np.convolve((y * y).sum(1), np.full(width, 1 / width), mode="same")
        post = np.full((t, k), (1 - regime.SEEDED) / (k - 1))
        post[np.arange(t), np.searchsorted(np.quantile(vol, np.arange(1, k) / k), vol)] = regime.SEEDED
        start, step, rest = maximise(y, x, post, np.where(np.eye(k), regime.STICKY, (1 - regime.STICKY) / (k - 1)) * t / k)
        score = -np.inf
        for _ in range(regime.ROUNDS):
            lik = densities(rest, y, x)
            fil, back, loglik, ahead = np.empty((t, k)), np.ones((t, k)), 0.0, start
            for i in range(t):
                fil[i] = ahead * lik[i]
                loglik += np.log(fil[i].sum())
                fil[i] /= fil[i].sum()
                ahead = fil[i] @ step
            moves = np.zeros((k, k))
            for i in range(t - 2, -1, -1):
                back[i] = step @ (lik[i + 1] * back[i + 1])
                pair = fil[i][:, None] * step * (lik[i + 1] * back[i + 1])
                moves += pair / pair.sum()
                back[i] /= back[i].sum()
            post = fil * back
            start, step, rest = maximise(y, x, post / post.sum(1, keepdims=True), moves)
            gain, score = loglik - score, loglik
            if gain < regime.TOLERANCE * t:
                break
        found.append((score, sorted(np.trace(rest[2], axis1=1, axis2=2))))
    return max(found, key=lambda f: f[0])


def series(n, length, channels=4):
    return np.stack([simulator.Simulator(s).steps(length)[0][:, :channels] for s in range(n)])


@pytest.mark.parametrize("channels", [1, 2, 4])
def test_fits_together_equal_fits_alone_and_the_plain_model(channels):
    x = series(4, 401, channels)
    m, score = regime.fit_many(x)
    for i in range(len(x)):
        alone, one = regime.fit(x[i])
        assert abs(one - score[i]) < 1e-7 * abs(one)
        assert all(np.allclose(a[0], b[i], rtol=1e-6, atol=1e-9) for a, b in zip(alone, m))
        want, traces = plain_fit(x[i])
        assert abs(want - score[i]) < 1e-6 * abs(want)
        assert np.allclose(np.trace(m.noise[i], axis1=1, axis2=2), traces, rtol=1e-5)
        assert np.allclose(m.step[i].sum(1), 1)


def test_a_series_costs_little_beside_others():
    x = series(24, 801)

    def cost(v):
        began = time.process_time()
        regime.fit_many(v)
        return time.process_time() - began

    assert min(cost(x) for _ in range(2)) < 12 * min(cost(x[:1]) for _ in range(3))


def test_segments_of_several_batches(spark, monkeypatch):
    """Refits that fall into three batches, the last segment cut short: as if each were fitted and filtered alone."""
    monkeypatch.setattr(regime, "BATCH", 3)
    how = dict(train=120, first=60, every=40)
    rows = simulator.simulate(spark, 1, 395, seed=3).cache()
    x = np.array([r["values"] for r in rows.orderBy("timestamp").collect()])
    fits = {r["fitted_at"]: r for r in regime.fit_segments(rows, ["timestamp"], **how).collect()}
    assert sorted(fits) == list(range(61, 396, 40))
    got = {r["r"]: r for r in regime.detect(rows, ["timestamp"], warmup=30, **how).collect()}
    assert sorted(got) == list(range(62, 396))
    for at, f in fits.items():
        assert f["segment"] == (at - 61) // 40
        m, loglik = regime.fit(x[max(0, at - 121) : at])
        assert abs(loglik - f["loglik"]) < 1e-6 * abs(loglik) and np.allclose(m.noise[0], f["noise"], rtol=1e-5, atol=1e-8)
        p = regime.filter_from(m, x[at - 31 : at + 40], np.full(3, 1 / 3))[30:]
        assert np.allclose([got[at + 1 + i]["probabilities"] for i in range(len(p))], p, atol=2e-6)
        assert [got[at + 1 + i]["state"] for i in range(len(p))] == p.argmax(1).tolist()


def test_stations_without_a_fit_and_odd_rows(spark):
    """Too few rows give none; rows with a missing channel are passed over; channels of different number are an error."""
    few = simulator.simulate(spark, 1, 50, seed=3)
    assert regime.fit_segments(few, ["timestamp"], train=120, first=60, every=40).count() == 0
    assert regime.detect(few, ["timestamp"], train=120, first=60, every=40).count() == 0
    odd = "CASE WHEN timestamp = 0 THEN array(1D, NULL, 2D, 3D) WHEN timestamp = 100 THEN NULL ELSE values END AS values"
    rows = simulator.simulate(spark, 1, 100, seed=3).selectExpr("station", "timestamp", odd, "IF(timestamp < 9000, regime, NULL) AS regime")
    got = regime.detect(rows, ["timestamp"], train=120, first=60, every=40, warmup=30).collect()
    assert sorted(r["r"] for r in got) == list(range(62, 99))
    assert {r["true_regime"] is None for r in got} == {True, False}
    with pytest.raises(Exception, match="different numbers of channels"):
        regime.fit_segments(rows.unionByName(rows.limit(3).selectExpr("station", "timestamp + 5 AS timestamp", "array(1D) AS values", "regime")), ["timestamp"], train=120, first=60, every=40).collect()
