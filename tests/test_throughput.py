"""Arrivals in a trailing span against DuckDB's window and brute force."""

import time

import pytest
from compare import SMALL, connect, difference
from pyspark.sql import functions as F

from gaugeflow.operators import views
from gaugeflow.plans import catalog


@pytest.mark.parametrize("span,chunk", [(10, None), (10, 4), (10, 35), (7, 1), (1000, 300)])
def test_counts_at_the_edges_of_span_and_chunk(spark, span, chunk):
    """Ties, negative times, gaps longer than a span, and times a whole span apart."""
    at = [-21, -11, -10, -10, -1, 0, 0, 0, 9, 10, 10, 11, 19, 20, 21, 30, 40, 41, 500, 500, 1510]
    rows = spark.createDataFrame(list(enumerate(at)), "id long, received long")
    got = {r["id"]: r["per_second"] for r in views.throughput(rows, span, chunk).collect()}
    assert got == {i: sum(t - span <= u <= t for u in at) / (span / 1000.0) for i, t in enumerate(at)}


def test_rows_without_a_time_and_other_columns(spark):
    """Rows without a time count each other, as in SQL; every column is carried, of repeated rows each."""
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 5, "c"), (3, 5, "c")], "id long, received long, x string")
    got = views.throughput(rows, 1000)
    assert got.columns == ["id", "received", "x", "per_second"]
    assert sorted((r["id"], r["x"], r["per_second"]) for r in got.collect()) == [(1, "a", 2.0), (2, "b", 2.0), (3, "c", 2.0), (3, "c", 2.0)]
    assert views.throughput(rows.limit(0), 1000).count() == 0


def test_query_equals_its_sql(spark):
    assert difference(catalog.QUERIES["throughput_trailing"](spark, SMALL), connect(SMALL), catalog.ORACLE_SQL["throughput_trailing"]) == ""


def test_a_full_span_costs_no_more_than_its_rows(spark):
    """120,000 arrivals of one span, each of which most others precede."""
    rows = spark.range(120_000).select((F.col("id") * 3).alias("received"))
    began = time.time()
    got = views.throughput(rows, 600_000).agg(F.max("per_second").alias("most"), F.count("*").alias("n")).first()
    assert (got["most"], got["n"]) == (120_000 / 600.0, 120_000)
    assert time.time() - began < 30
