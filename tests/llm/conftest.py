from __future__ import annotations

import pytest
from awkward_docs import SCHEMA, awkward_rows


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    clash = {c: F.lit(f"mine-{c}") for c in ("score", "predicted", "node", "sketch", "key", "text2", "__node", "__dropped", "held_out", "lang_pred", "toxic", "pos", "line")}
    return df.withColumns(clash).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
