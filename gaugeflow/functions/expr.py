"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .student import t_quantile


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since the epoch of a timestamp without time zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def align(ts: Column, window_ms: int) -> Column:
    """Start of the tumbling window that holds ts; floors below zero too."""
    return ts - F.pmod(ts, F.lit(window_ms))


def next_tick(now: Column, step_ms: int) -> Column:
    """First point of the grid that lies after now; a point of the grid itself counts as not yet passed."""
    before = now - 1
    return before - F.pmod(before, F.lit(step_ms)) + step_ms + 1


def is_finite(v: Column) -> Column:
    return F.abs(v) < F.lit(float("inf"))


def valid_station(station: Column) -> Column:
    return F.coalesce(station.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def clock(ts: Column, offset_minutes: int = 0) -> Column:
    """HH:MM:SS of epoch milliseconds at an offset from UTC, by arithmetic alone."""
    s = F.pmod(F.floor((ts + offset_minutes * 60_000) / 1000), F.lit(86_400)).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)


def argmax_first(array: Column) -> Column:
    """Index, from 0, of the largest element; the first of equals."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def t_value(df: Column, p: float, least: int = 17, most: int = 57) -> Column:
    """Student's t quantile for a whole number of degrees of freedom in a known range, as a literal map."""
    table = F.create_map(*[F.lit(x) for d in range(least, most + 1) for x in (d, t_quantile(p, d))])
    return table[df.cast("int")]


def best_mapping(cells: list[list[Column]]) -> tuple[Column, Column]:
    """Largest sum of cells over the one-to-one mappings of rows to columns, and that mapping as an array; the first in
    lexicographic order of equals."""
    k = len(cells)
    every = list(permutations(range(k)))
    sums = [reduce(lambda a, b: a + b, (cells[i][p[i]] for i in range(k))) for p in every]
    top = F.greatest(*sums)
    mapping = F.coalesce(*[F.when(s == top, F.array(*[F.lit(x) for x in p])) for s, p in zip(sums, every)])
    return top, mapping
