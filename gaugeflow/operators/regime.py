"""Hidden regimes: Markov-switching autoregression by EM, online filtering, relabelling and accuracy.

A channel's change is level + slope * its value before, with noise that is correlated across channels; level, slope
and noise switch with a hidden Markov chain. Rows of a station are cut into segments between refits. A segment needs its
training window and its own rows only, since filtering restarts from a uniform prior at every refit, so segments are
independent however long a station's history is. Neighbours share most of their training rows and are fitted together:
a group is a bounded number of segments, and one step of the recursions serves all their starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import argmax_first, best_mapping

STATES, TRAIN, FIRST, EVERY, WARMUP, PUBLISH, SCORED = 3, 3000, 1200, 600, 300, 5, 3000
SMOOTH = (10, 25, 60)
STICKY, SEEDED = 0.99, 0.95
ROUNDS, TOLERANCE, RIDGE = 40, 1e-5, 1e-8
#: Segments that one group fits together, and the steps that a pass over all its series takes at a time.
BATCH, SLICE = 32, 64


class Regimes(NamedTuple):
    """Parameters of S models at once: first axis is the model."""

    start: np.ndarray  # S, K
    step: np.ndarray  # S, K, K
    level: np.ndarray  # S, K, d
    slope: np.ndarray  # S, K, d
    noise: np.ndarray  # S, K, d, d

    def pick(self, best: np.ndarray, order: np.ndarray) -> Regimes:
        """Models best (n), the states of each in its order (n, K)."""
        at = best[:, None]
        return Regimes(self.start[at, order], self.step[at[:, :, None], order[:, :, None], order[:, None]], *(v[at, order] for v in self[2:]))


def moving_average(v: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(v, np.full(width, 1.0 / width), mode="same")


# The models of a batch are fitted together. In what follows time comes first and the model last, so one step of a
# recursion is a few operations on neighbouring numbers, whatever the number of models.


def _last(v: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.moveaxis(v, 0, -1))


def log_density(m: Regimes, change: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(T, K, S) log densities under each state; change and before: (T, d, S)."""
    level, slope, inverse = _last(m.level), _last(m.slope), _last(np.linalg.inv(m.noise))
    _, logdet = np.linalg.slogdet(m.noise)
    const, d = logdet.T + change.shape[1] * np.log(2 * np.pi), change.shape[1]
    out = np.empty((len(change), *const.shape))
    for a in range(0, len(change), SLICE):
        y, x = change[a : a + SLICE, None], before[a : a + SLICE, None]
        gap = y - level - slope * x
        total = np.broadcast_to(const, (len(gap), *const.shape)).copy()
        for i in range(d):
            row = inverse[:, i, i] * gap[:, :, i]
            for j in range(i + 1, d):
                row += (inverse[:, i, j] + inverse[:, j, i]) * gap[:, :, j]
            row *= gap[:, :, i]
            total += row
        np.multiply(total, -0.5, out=out[a : a + SLICE])
    return out


def smooth(m: Regimes, dens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed state probabilities (T, K, S), expected transitions (K, K, S) and log-likelihoods (S). Both passes run
    at once, one from each end: each weighs a vector by the likelihoods, scales it to sum 1 and takes it a step on."""
    t, k, s = dens.shape
    top = dens.max(1)
    lik = np.empty((t, k, 2, s))
    np.exp(dens - top[:, None], out=lik[:, :, 0])
    lik[:, :, 1] = lik[::-1, :, 0]
    on = np.empty((k, k, 2, s))  # from, to
    on[:, :, 0] = _last(m.step)
    on[:, :, 1] = on[:, :, 0].swapaxes(0, 1)
    scale, moved, work = np.empty((t, 2, s)), np.empty((t, k, 2, s)), np.empty((k, k, 2, s))
    now = np.ones((k, 2, s))
    now[:, 0] = m.start.T
    for v, total, ahead in zip(lik, scale, moved):
        np.multiply(now, v, out=v)
        np.add.reduce(v, 0, out=total)
        np.divide(v, total, out=v)
        np.multiply(on, v[:, None], out=work)
        now = np.add.reduce(work, 0, out=ahead)
    fil, later = lik[:, :, 0], lik[::-1, :, 1]
    post, moves = np.empty((t, k, s)), np.zeros((k, k, s))
    for a in range(0, t - 1, SLICE):
        b = min(a + SLICE, t - 1)
        # what comes after a step, seen from it: the backward pass took the next one a step on
        p = np.multiply(fil[a:b], moved[t - 1 - b : t - 1 - a, :, 1][::-1], out=post[a:b])
        total = p.sum(1, keepdims=True)
        p /= total
        moves += np.einsum("tks,tls->kls", fil[a:b] / total, later[a + 1 : b + 1])
    post[-1] = fil[-1]
    return post, moves * on[:, :, 0], np.log(scale[:, 0]).sum(0) + top.sum(0)


def weighted_fit(change: np.ndarray, before: np.ndarray, post: np.ndarray, moves: np.ndarray) -> Regimes:
    """Maximises the expected likelihood: per state and channel a weighted regression, then the weighted residuals'
    covariance. change, before: (T, d, S); post: (T, K, S); moves: (K, K, S)."""
    (t, d, s), k = change.shape, post.shape[1]
    sums = np.zeros((4, k, d, s))
    for a in range(0, t, SLICE):
        p, y, x = post[a : a + SLICE], change[a : a + SLICE], before[a : a + SLICE]
        for out, v in zip(sums, (x, y, x * x, x * y)):
            out += np.einsum("tks,tds->kds", p, v)
    w = post.sum(0)[:, None] + 1e-12
    sx, sy, sxx, sxy = sums
    slope = (w * sxy - sx * sy) / (w * sxx - sx * sx + RIDGE)
    level = (sy - slope * sx) / w
    noise = np.zeros((k, d, d, s))
    for a in range(0, t, SLICE):
        gap = change[a : a + SLICE, None] - level - slope * before[a : a + SLICE, None]
        for i in range(d):
            weighed = post[a : a + SLICE] * gap[:, :, i]
            for j in range(i, d):
                noise[:, i, j] += np.einsum("tks,tks->ks", weighed, gap[:, :, j])
    for i in range(d):
        noise[:, i, i] += RIDGE * w[:, 0]
        for j in range(i):
            noise[:, i, j] = noise[:, j, i]
    first = post[0] / post[0].sum(0)
    return Regimes(*(np.moveaxis(v, -1, 0) for v in (first, moves / moves.sum(1, keepdims=True), level, slope, noise / w[..., None, :])))


def fit_many(levels: np.ndarray, k: int = STATES, previous: Regimes | None = None) -> tuple[Regimes, np.ndarray]:
    """Of each series of levels (n, T + 1, d) the best of several starts by likelihood, all advanced together, each until
    it gains no more; states in ascending order of total noise. Starts: the previous models if given, and splits of the
    series into groups of local volatility at several smoothings."""
    n, t = len(levels), levels.shape[1] - 1
    change, before = np.diff(levels, axis=1), levels[:, :-1]
    post = np.full((t, k, len(SMOOTH), n), (1 - SEEDED) / max(k - 1, 1))
    for c, one in enumerate(change):
        energy = (one * one).sum(1)
        for i, width in enumerate(SMOOTH):
            vol = moving_average(energy, width)
            group = np.searchsorted(np.quantile(vol, np.arange(1, k) / k), vol)
            post[np.arange(t), group, i, c] = SEEDED
    lanes = lambda v, which: np.ascontiguousarray(v[which].transpose(1, 2, 0))
    off = (1 - STICKY) / max(k - 1, 1)
    sticky = np.where(np.eye(k, dtype=bool), STICKY, off)
    which = np.tile(np.arange(n), len(SMOOTH))
    y, x = lanes(change, which), lanes(before, which)
    m = weighted_fit(y, x, post.reshape(t, k, -1), np.repeat((sticky * t / k)[..., None], len(which), 2))
    if previous is not None:
        m = Regimes(*(np.concatenate([p, v]) for p, v in zip(previous, m)))
        which = np.concatenate([np.arange(n), which])
        y, x = lanes(change, which), lanes(before, which)
    m = Regimes(*(v.copy() for v in m))
    score = np.full(len(which), -np.inf)
    going = np.arange(len(which))
    for _ in range(ROUNDS):
        part = Regimes(*(v[going] for v in m))
        post, moves, loglik = smooth(part, log_density(part, y, x))
        new = weighted_fit(y, x, post, moves)
        for old, v in zip(m, new):
            old[going] = v
        gain = loglik - score[going]
        score[going] = loglik
        stay = gain >= TOLERANCE * t
        if not stay.any():
            break
        if not stay.all():
            going, y, x = going[stay], np.ascontiguousarray(y[..., stay]), np.ascontiguousarray(x[..., stay])
    best = score.reshape(-1, n).argmax(0) * n + np.arange(n)
    order = np.argsort(np.trace(m.noise[best], axis1=2, axis2=3), axis=1, kind="stable")
    return m.pick(best, order), score[best]


def fit(levels: np.ndarray, k: int = STATES, previous: Regimes | None = None) -> tuple[Regimes, float]:
    """fit_many of one series."""
    m, score = fit_many(levels[None], k, previous)
    return m, float(score[0])


def filter_many(m: Regimes, levels: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Filtered probabilities (T, K, n) after each change of each of n series (n, T + 1, d), from a prior (K, n); a change
    that no state explains leaves the prediction as it is."""
    dens = log_density(m, _last(np.diff(levels, axis=1)), _last(levels[:, :-1]))
    step, out = _last(m.step), np.empty_like(dens)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        lik = np.exp(dens - dens.max(1, keepdims=True))
        for i in range(len(dens)):
            ahead = (prior[:, None] * step).sum(0)
            joint = ahead * lik[i]
            total = joint.sum(0)
            prior = out[i] = np.where(np.isfinite(total) & (total > 0), joint / total, ahead)
    return out


def filter_from(m: Regimes, levels: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """filter_many of one series: (T, K)."""
    return filter_many(m, levels[None], prior[:, None])[..., 0]


def numbered(raw: DataFrame, order: list[str]) -> DataFrame:
    """Adds r, the place of a station's row from 1; rows with a missing or non-finite channel are left out."""
    whole = raw.where(~F.exists("values", lambda v: ~F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    return whole.withColumn("r", F.row_number().over(Window.partitionBy("station").orderBy(*order)).cast("long"))


def _batches(rows: DataFrame, first: int, every: int, train: int):
    """Copies each row to the batches of BATCH segments that train on it or filter it; segment i is fitted at row
    first + 1 + i * every. Batches are dealt out evenly, since they hold few rows but much work."""
    at = F.lit(first + 1)
    low = F.greatest(F.lit(0), F.ceil((F.col("r") - at - every) / F.lit(every)))
    high = F.floor((F.col("r") + train - at) / F.lit(every))
    batch = lambda i: F.floor(i / F.lit(BATCH))
    rows = rows.where(high >= 0).withColumn("batch", F.explode(F.sequence(batch(low), batch(high))))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "station", "batch").groupBy("station", "batch")


def _levels(rows: pa.Table) -> np.ndarray:
    """The values of all rows, (rows, d)."""
    v = rows.column("values").combine_chunks()
    if len(set(pc.list_value_length(v).unique().to_pylist())) > 1:
        raise ValueError("rows with different numbers of channels")
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def _fitted(x: np.ndarray, r: np.ndarray, segment: np.ndarray, k: int, train: int, first: int, every: int) -> Iterator[tuple[np.ndarray, np.ndarray, Regimes, np.ndarray, int]]:
    """Those segments that have all the rows they train on: number, place in x of the row they are fitted at, models
    and log-likelihoods, and the number of changes they train on, by which they come together. r are neighbours."""
    at = first + 1 + segment * every
    segment, at = segment[at <= r[-1]], at[at <= r[-1]]
    size = np.minimum(at - 1, train)
    for n in np.unique(size):
        own, place = segment[size == n], at[size == n] - r[0]
        m, loglik = fit_many(x[place[:, None] + np.arange(-n, 1)], k)
        yield own, place, m, loglik, int(n)


FIT = "station string, segment long, fitted_at long, loglik double, start array<double>, step array<array<double>>, level array<array<double>>, slope array<array<double>>, noise array<array<array<double>>>"
_D1 = pa.list_(pa.float64())
_D2 = pa.list_(_D1)
_FIT = pa.schema(zip([c.split(" ")[0] for c in FIT.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.float64(), _D1, _D2, _D2, _D2, pa.list_(_D2)]))


def fit_segments(raw: DataFrame, order: list[str], k: int = STATES, train: int = TRAIN, first: int = FIRST, every: int = EVERY) -> DataFrame:
    """One model per station and refit, fitted on the last train + 1 rows."""
    batch = BATCH

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("r")
        out = []
        for segment, _, m, loglik, _ in _fitted(_levels(rows), rows.column("r").to_numpy(), key[1].as_py() * batch + np.arange(batch), k, train, first, every):
            out.append(pa.table([pa.array([key[0].as_py()] * len(segment), pa.string()), segment, first + 1 + segment * every, loglik, *(pa.array(v.tolist(), f.type) for v, f in zip(m, list(_FIT)[4:]))], schema=_FIT))
        return pa.concat_tables([_FIT.empty_table(), *out])

    return _batches(numbered(raw, order).select("station", "values", "r"), first, every, train).applyInArrow(run, FIT)


DETECTED = "station string, timestamp long, r long, true_regime int, probabilities array<double>"
_DETECTED = pa.schema(zip([c.split()[0] for c in DETECTED.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.int32(), _D1]))


def detect(raw: DataFrame, order: list[str], k: int = STATES, train: int = TRAIN, first: int = FIRST, every: int = EVERY, warmup: int = WARMUP) -> DataFrame:
    """Filtered state probabilities of every row after a station's first fit, rounded to six places, and the most likely
    state. Each segment fits its model and filters its rows in one task."""
    batch = BATCH

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("r")
        x, r = _levels(rows), rows.column("r").to_numpy()
        out = []
        for _, place, m, _, n in _fitted(x, r, key[1].as_py() * batch + np.arange(batch), k, train, first, every):
            warm = min(warmup, n)
            # a segment that ends early is carried on by its last row and cut off after
            p = filter_many(m, x[np.minimum(place[:, None] + np.arange(-warm, every + 1), len(x) - 1)], np.full((k, len(place)), 1.0 / k))
            p = np.round(p[warm:], 6).transpose(2, 0, 1)
            here = place[:, None] + np.arange(1, every + 1)
            here, p = here[here < len(x)], p[here < len(x)]
            got = rows.take(pa.array(here))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            out.append(pa.table([got.column("station"), got.column("timestamp"), got.column("r"), got.column("regime"), lists], schema=_DETECTED))
        return pa.concat_tables([_DETECTED.empty_table(), *out])

    rows = numbered(raw.select("station", "timestamp", "values", F.col("regime").cast("int").alias("regime"), *[c for c in order if c not in ("timestamp",)]), order)
    out = _batches(rows.select("station", F.col("timestamp").cast("long").alias("timestamp"), "values", "regime", "r"), first, every, train).applyInArrow(run, DETECTED)
    return out.withColumn("state", argmax_first(F.col("probabilities")))


def confusion(rows: DataFrame, order: str, last: int = SCORED, k: int = STATES) -> DataFrame:
    """rows: station, order, state, truth. Adds n_scored, accuracy under the best one-to-one relabelling of the last
    scored rows, and mapped_state. A truth or state that isn't one of k isn't scored."""
    w = Window.partitionBy("station").orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # whole numbers: a difference of running sums is exact, and costs the same however long the frame is
    within = lambda n: F.col(n) - F.coalesce(F.lag(n, last).over(w), F.lit(0))
    rows = rows.where(F.col("truth").between(0, k - 1) & F.col("state").between(0, k - 1))
    cell: list[list[Column]] = [[F.col(f"__{i}{j}") for j in range(k)] for i in range(k)]
    rows = rows.withColumns({f"__{i}{j}": F.sum(((F.col("state") == i) & (F.col("truth") == j)).cast("long")).over(so_far) for i in range(k) for j in range(k)} | {"__n": F.count("*").over(so_far)})
    rows = rows.withColumns({f"__{i}{j}": within(f"__{i}{j}") for i in range(k) for j in range(k)} | {"n_scored": F.least("__n", F.lit(last))}).drop("__n")
    top, mapping = best_mapping(cell)
    rows = rows.withColumn("matched", top).withColumn("mapped_state", mapping[F.col("state")])
    return rows.withColumn("accuracy", F.col("matched") / F.col("n_scored")).withColumnsRenamed({f"__{i}{j}": f"c{i}{j}" for i in range(k) for j in range(k)})


def latest_fit(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """The model in force at each row: the newest fitted before it. An as-of look-up by a union in order."""
    both = rows.select("station", F.col("r").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("fitted_at")).unionByName(fits.select("station", F.col("fitted_at").alias("at"), F.lit(2).alias("kind"), "fitted_at"))
    w = Window.partitionBy("station").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("fitted_at", F.last("fitted_at", ignorenulls=True).over(w)).where(F.col("kind") == 1).select("station", F.col("at").alias("r"), "fitted_at")


def regime_messages(detected: DataFrame, every: int = PUBLISH) -> DataFrame:
    """Every n-th filtered row of a station."""
    w = Window.partitionBy("station").orderBy("r")
    return detected.withColumn("__n", F.row_number().over(w)).where(F.col("__n") % every == 0).drop("__n")
