import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusmill.session import build_session, send_code_with_tasks  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    send_code_with_tasks()
    session = build_session("tests", master="local[8]", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a Column built on a single row of literals."""

    def value(column_of, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return row.select(column_of(*[F.col(k) for k in values]).alias("r")).first()["r"]

    return value
