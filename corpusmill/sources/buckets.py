"""Bucketed tables in a folder: written in batches, opened again by any later session.

A manifest beside the data keeps schema, key, order and number of buckets, so the folder is read with the buckets it was
written with, whatever the settings of the session. No table stays in the catalog.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create(spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int) -> None:
    """An empty table at a path that holds none."""
    manifest = json.dumps({"schema": schema, "key": key, "order": order, "buckets": buckets})
    spark.range(1, numPartitions=1).select(F.lit(manifest).alias("value")).write.text(f"{path}/manifest")


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    """What the table was made with; None where the path holds no table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def _registered(spark: SparkSession, path: str, made: dict) -> str:
    name = f"bucketed_{uuid.uuid4().hex}"
    buckets = f"CLUSTERED BY ({made['key']}) SORTED BY ({made['order']}) INTO {made['buckets']} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({made['schema']}) USING parquet {buckets} LOCATION '{path}/data'")
    return name


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The rows written so far. Joins and groups on the key need no shuffle of them."""
    name = _registered(spark, path, manifest_of(spark, path))
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the frame knows them
    return rows


def append(rows: DataFrame, path: str) -> None:
    """Add rows of the table's schema; every bucket gets one sorted file."""
    spark = rows.sparkSession
    made = manifest_of(spark, path)
    name = _registered(spark, path, made)
    dealt = rows.repartition(made["buckets"], made["key"]).write.format("parquet").mode("append")
    dealt.bucketBy(made["buckets"], made["key"]).sortBy(*made["order"].split(", ")).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
