"""Registry of the checked queries: a Spark callable, its survey rows and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_ROWS: dict[str, str] = {}


def query(rows: str, sql: str | None = None):
    """Register a function under its own name. ``rows`` lists the inventory rows it covers."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        SURVEY_ROWS[fn.__name__] = rows
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(text: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"
