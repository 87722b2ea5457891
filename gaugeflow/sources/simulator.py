"""Synthetic stations: mean-reverting channels whose parameters switch with a hidden regime, with correlated shocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the simulated model, per regime.
THETA = (0.01, 0.02, 0.015)
MU = ((0.0, 0.0, 0.0, 0.0), (1.0, 2.0, 1.0, 2.0), (-2.0, -2.0, -1.0, -1.0))
SIGMA = (0.2, 0.15, 0.25)
TRANSITION = ((0.995, 0.002, 0.003), (0.004, 0.992, 0.004), (0.005, 0.0025, 0.9925))
CORRELATION_RANGE = 0.3
MAX_STATIONS = 26

RAW = "station string, timestamp long, values array<double>, regime int"


def cholesky(m: np.ndarray) -> np.ndarray | None:
    """Lower factor, or None where the matrix isn't positive definite."""
    try:
        return np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return None


def random_correlation(rng: np.random.Generator, d: int) -> np.ndarray:
    """Off-diagonal entries uniform within the range, drawn again until the matrix is positive definite."""
    while True:
        m = np.eye(d)
        upper = np.triu_indices(d, 1)
        m[upper] = rng.uniform(-CORRELATION_RANGE, CORRELATION_RANGE, len(upper[0]))
        m = m + np.triu(m, 1).T
        if cholesky(m) is not None:
            return m


class Simulator:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.correlation = [random_correlation(self.rng, len(MU[0])) for _ in MU]
        self.mix = [cholesky(m) for m in self.correlation]
        self.regime, self.state = 0, np.array(MU[0])

    def steps(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n samples and the regime after each: a step moves by the regime before it, then draws the next."""
        shock, draw = self.rng.standard_normal((n, len(MU[0]))), self.rng.random(n)
        ends = np.cumsum(TRANSITION, axis=1)
        out, regimes = np.empty((n, len(MU[0]))), np.empty(n, np.int32)
        for i in range(n):
            r = self.regime
            self.state = self.state + THETA[r] * (np.array(MU[r]) - self.state) + SIGMA[r] * (self.mix[r] @ shock[i])
            k = int(np.searchsorted(ends[r], draw[i], side="right"))
            self.regime = k if k < len(MU) else r
            out[i], regimes[i] = self.state, self.regime
        return out, regimes


def station_name(i: int) -> str:
    return f"Station{chr(ord('A') + i)}"


def simulate(spark: SparkSession, stations: int, samples: int, seed: int = 0, start_ms: int = 0, step_ms: int = 100, chunk: int = 5000) -> DataFrame:
    """Raw samples of stations A, B, ... on a common time grid; station i uses seed + i, so it is the same however many
    there are. Each station is one task that emits bounded chunks."""
    if not 1 <= stations <= MAX_STATIONS:
        raise ValueError(f"stations must lie between 1 and {MAX_STATIONS}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f["id"]:
                sim, at = Simulator(seed + int(i)), 0
                while at < samples:
                    n = min(chunk, samples - at)
                    values, regimes = sim.steps(n)
                    yield pd.DataFrame({"station": station_name(int(i)), "timestamp": start_ms + (at + np.arange(n)) * step_ms, "values": list(values), "regime": regimes})
                    at += n

    return spark.range(0, stations, 1, stations).mapInPandas(run, RAW)
