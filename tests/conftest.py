from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storyline.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def column(spark):
    """Evaluate a column function over Python values: ``column(function, values)``."""

    def run(function, *values):
        names = [f"c{i}" for i in range(len(values))]
        schema = "row int, " + ", ".join(f"{n} string" for n in names)
        rows = [(i, *v) for i, v in enumerate(zip(*values))]
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        found = df.select("row", function(*[F.col(n) for n in names]).alias("value")).orderBy("row").collect()
        return [r.value for r in found]

    return run
