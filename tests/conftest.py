from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from souba.session import local_session
    session = local_session("tests", 8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows(df) -> list of dicts."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="session")
def evaluate(spark):
    """evaluate(texts, column function) -> values, in order."""
    from pyspark.sql import functions as F

    def run(values, function):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        out = df.select("i", function(F.col("t")).alias("o")).orderBy("i").collect()
        return [r["o"].asDict() if hasattr(r["o"], "asDict") else r["o"] for r in out]
    return run
