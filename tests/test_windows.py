"""Window operator: random streams against a sequential model, and the cases that its rules turn on."""

import random
from collections import defaultdict
from math import inf, isfinite, nan

from pyspark.sql import functions as F

from gaugeflow.operators import windows

RAW = "station string, timestamp long, values array<double>, regime int, arrival long, event_id long"


def stream(rng, n):
    rows = []
    for i in range(n):
        values = [rng.choice([nan, inf]) if rng.random() < 0.2 else rng.uniform(-1e6, 1e6) for _ in range(rng.randint(1, 4))]
        rows.append((rng.choice("ABC"), rng.randrange(20_000), values, rng.choice([None, 0, 1, 2]), i * 7, i))
    return rows


def model(rows, w, lateness):
    """Late flags and windows when a station's windows close after every event."""
    newest, late, open_ = {}, [], defaultdict(list)
    for st, ts, values, regime, _, i in rows:
        start = ts - ts % w
        is_late = st in newest and start + w <= newest[st] - lateness
        late.append((i, is_late))
        if not is_late:
            newest[st] = max(ts, newest.get(st, ts))
            open_[st, start].append((values, regime))
    out = {}
    for (st, start), events in open_.items():
        known = [r for _, r in events if r is not None]
        best = min(sorted(set(known)), key=lambda r: (-known.count(r), r)) if known else None
        for k in range(max(len(v) for v, _ in events)):
            own = [v[k] for v, _ in events if k < len(v) and isfinite(v[k])]
            if own:
                out[st, k, start] = (len(own), round(sum(own) / len(own), 3), min(own), max(own), best)
    return late, out


def test_random_streams(spark):
    rng = random.Random(5)
    for _ in range(4):
        w, lateness = rng.randint(50, 1999), rng.randint(0, 999)
        rows = stream(rng, 250)
        df = spark.createDataFrame(rows, RAW)
        marked = windows.mark_late(df, w, lateness)
        late, want = model(rows, w, lateness)
        assert sorted((r["event_id"], r["late"]) for r in marked.collect()) == late
        got = windows.stats(marked.where(~F.col("late")), w).collect()
        assert {(r["station"], r["sensor"], r["timestamp"]): (r["count"], round(r["mean"], 3), r["min"], r["max"], r["regime"]) for r in got} == want
        assert len(got) == len(want)
        assert all(r["min"] <= r["mean"] + 1e-6 and r["mean"] <= r["max"] + 1e-6 and r["timestamp"] % w == 0 for r in got)


def rows_of(spark, rows):
    return spark.createDataFrame([(s, t, [v], None, i, i) for i, (s, t, v) in enumerate(rows)], RAW)


def test_equal_to_the_bound_is_late(spark):
    df = rows_of(spark, [("A", 1000, 1.0), ("A", 1500, 1.0), ("A", 1499, 1.0), ("A", 1600, 1.0)])
    assert [r["late"] for r in windows.mark_late(df, 500, 0).orderBy("event_id").collect()] == [False, False, True, False]


def test_stations_do_not_delay_each_other(spark):
    df = rows_of(spark, [("A", 5000, 1.0), ("B", 1200, 1.0), ("B", 1300, 1.0)])
    assert not any(r["late"] for r in windows.mark_late(df, 500, 0).collect())
    assert [r["late"] for r in windows.mark_late_globally(df, 500, 0).orderBy("event_id").collect()] == [False, True, True]


def test_floor_below_zero(spark):
    got = windows.tumbling(rows_of(spark, [("A", -1, 2.0), ("A", -500, 4.0), ("A", -501, 8.0)]), 500).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["mean"]) for r in got] == [(-1000, 8.0), (-500, 3.0)]


def test_window_without_finite_value_is_silent_but_counts_its_regime(spark):
    df = spark.createDataFrame([("A", 10, [nan, 1.0], 2, 0, 0), ("A", 20, [inf, inf], 2, 1, 1), ("A", 30, [nan, 3.0], 1, 2, 2)], RAW)
    got = windows.stats(df, 500).collect()
    assert [(r["sensor"], r["count"], r["mean"], r["regime"]) for r in got] == [(1, 2, 2.0, 2)]


def test_idle_is_strict(spark):
    df = rows_of(spark, [("A", 1000, 1.0), ("B", 1001, 1.0)])
    assert {r["station"] for r in windows.idle_close(df, 500, 0, 100, 1101).collect()} == {"A"}


def test_empty_table(spark):
    assert windows.stats(spark.createDataFrame([], RAW), 500).count() == 0
