"""Rows of a Spark query against those of its SQL."""

from __future__ import annotations

import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _key(row):
    return tuple((v is None, str(type(v).__name__) if v is None else "", v if v is not None else 0) for v in row)


def difference(spark_df, con, sql: str) -> str:
    """Empty if both have the same rows, else what differs first."""
    names = sorted(spark_df.columns)
    got = [tuple(r[n] for n in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows for {len(want)}"
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if a != b:
            return f"{dict(zip(names, a))} for {dict(zip(names, b))}"
    return ""
