"""Sinks: partitioned appends, exports and logs. Batching is Spark's own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from corpusmill.functions import fixed
from corpusmill.functions.meta import label_of
from corpusmill.sources.readers import read_or_empty


ROWS_A_FILE = 1_000_000


def append_by(rows: DataFrame, path: str, keys: tuple[str, ...], job: str | None = None, rows_a_file: int = ROWS_A_FILE) -> None:
    """Append to a table with a folder for every key and job.

    A large key is dealt over files of about ``rows_a_file`` rows, a small one gets one file, whatever the number of tasks.
    A job that is run again under its name replaces the rows that it wrote before.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / rows_a_file).alias("_files")).select(F.struct(*keys).alias("_key"), "_files")
    sized = rows.withColumn("_key", F.struct(*keys)).join(sizes, "_key")
    file = F.pmod(F.xxhash64(*[c for c in rows.columns if not isinstance(rows.schema[c].dataType, (MapType, VariantType))]), "_files")
    dealt = sized.withColumn("_file", file).repartition("_key", "_file").drop("_key", "_files", "_file")
    named = dealt.withColumn("job", F.lit(job or uuid.uuid4().hex))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "job").parquet(path)


def append_chunks(chunks: DataFrame, path: str, partition_by: tuple[str, ...] = ("storage_id",), job: str | None = None) -> None:
    append_by(chunks, path, partition_by, job)


def export_chunks(chunks: DataFrame, path: str, fmt: str = "json") -> None:
    """Chunks as JSON lines or Parquet files."""
    chunks.write.mode("overwrite").format(fmt).save(path)


def append_vectors(vectors: DataFrame, path: str, job: str | None = None) -> None:
    """Vector table partitioned so that one index is one folder."""
    append_by(vectors, path, ("storage_id", "engine"), job)


def load_vectors(spark: SparkSession, path: str, storage_id: str | None = None, engine: str | None = None) -> DataFrame:
    """Vectors of one index by partition pruning; an empty table when nothing is stored yet."""
    schema = "chunk_id long, embedding array<float>, storage_id string, engine string"
    stored = read_or_empty(spark, path, schema)
    if storage_id is not None:
        stored = stored.filter(F.col("storage_id") == storage_id)
    return stored if engine is None else stored.filter(F.col("engine") == engine)


def log_retrieval(hits: DataFrame, queries: DataFrame, model: str, at: Column) -> DataFrame:
    """One log row per query with its chunk ids in rank order; ``hits`` holds at most k per query."""
    ids = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    found = hits.groupBy("query_id").agg(F.transform(ids, lambda h: h["chunk_id"]).alias("chunk_ids"))
    empty = F.array().cast("array<bigint>")
    return queries.join(found, "query_id", "left").select(
        "query_id", "text", F.coalesce("chunk_ids", empty).alias("chunk_ids"), F.lit(model).alias("model"), at.alias("ts")
    )


def catalogue_rows(documents: DataFrame) -> DataFrame:
    """The seven columns of the catalogue export."""
    return documents.select(
        F.col("source_id").cast("string").alias("id"),
        "title",
        F.coalesce("description", F.lit("")).alias("description"),
        "path",
        F.col("url").alias("link"),
        F.when(F.col("output_format") == "f", "file").otherwise("text").alias("format"),
        label_of(F.col("status"), fixed.SOURCE_STATUS).alias("status"),
    )


def export_catalogue(documents: DataFrame, path: str) -> None:
    catalogue_rows(documents).write.mode("overwrite").option("header", True).csv(path)


def rows_from_listing(listing: DataFrame, report_id: int) -> DataFrame:
    """New source rows from a file listing."""
    return listing.filter(~F.col("is_dir")).select(
        F.col("file_name").alias("title"), "path", "file_id", "url", F.lit(report_id).cast("long").alias("report_id")
    )
