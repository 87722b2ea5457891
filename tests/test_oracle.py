"""Every query against its SQL, over the smallest tables."""

import pytest
from compare import SMALL, connect, difference

from gaugeflow.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert difference(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLE_SQL[name]) == ""


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"simulated_raw", "regime_em", "hamilton_filter"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
