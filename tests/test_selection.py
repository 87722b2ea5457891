"""Resolved choices against the rule spelled out over sets."""

import itertools

import pytest

from gaugeflow.operators.selection import kpi_text, resolved, series_of


def table(spark, values, kind="string", name="station"):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} {kind}, place int")


@pytest.mark.parametrize("view,asked,existing,want", [
    ("single", ["north", "south"], ["east", "south", "north"], ["north"]),
    ("single", ["gone"], ["east", "south"], ["east"]),
    ("single", [], [], []),
    ("several", ["south", None, "south", "gone", "east"], ["east", "south"], ["south", "east"]),
    ("several", [None], ["west", "east"], ["west"]),
    ("comparison", ["south"], ["east", "south", "west"], ["east", "south", "west"]),
    ("comparison", ["west", "south"], ["east", "south", "west"], ["west", "south"]),
])
def test_resolved(spark, view, asked, existing, want):
    got = resolved(table(spark, asked), table(spark, existing), "station", view).orderBy("place")
    assert [r["station"] for r in got.collect()] == want


def test_series_of(spark):
    every = list(itertools.product(["p", "q", "r"], range(3)))
    existing = spark.createDataFrame(every[:-1], "station string, sensor int")
    got = series_of(existing, table(spark, ["r", "p"]), table(spark, [2, 0], "int", "sensor"))
    assert {tuple(r) for r in got.collect()} == {("p", 0), ("p", 2), ("r", 0)}


def test_tiles(spark):
    df = spark.createDataFrame([(1.204, 0.5, 12, 103.6), (None, None, 0, None)], "mase double, coverage double, active long, latency_ms_p50 double")
    assert [r.asDict() for r in kpi_text(df).collect()] == [{"mase": "1.20", "coverage": "50.0%", "active": "12", "latency_ms_p50": "104 ms"}, {"mase": "–", "coverage": "–", "active": "0", "latency_ms_p50": "–"}]
