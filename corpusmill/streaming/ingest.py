"""Incremental page ingest: a stream of raw pages classified against the catalogue batch by batch.

Catalogue and contents lie in buckets by url. A batch reads the buckets of its own urls and no others, so its work does not
grow with the catalogue as long as it touches few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusmill.functions.html import PageConfig
from corpusmill.operators import sync
from corpusmill.operators.pages import extract_pages

CATALOGUE = "url string, source_id long, status string"
CONTENTS = "source_id long, content_id long, hash string, status string, created_at long"
BUCKETS = 64


def bucket_of(url: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def touched_rows(spark: SparkSession, path: str, schema: str, buckets: list[int], before: int) -> DataFrame:
    """Rows of these buckets that batches before this one wrote; no other folder is listed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [b for b in buckets if files.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"bucket={b}"))]
    schema = f"{schema}, bucket int, batch long"
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/bucket={b}" for b in there]).filter(F.col("batch") < before)


def _write(rows: DataFrame, path: str, number: int) -> None:
    """Into the folder of every bucket and this batch: a repeated batch replaces its own rows only."""
    rows = rows.withColumn("batch", F.lit(number).cast("long")).repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def ingest_pages(pages: DataFrame, root: str, config: PageConfig = PageConfig(), buckets: int = BUCKETS) -> StreamingQuery:
    """Run over what is new in a stream of (page_id, url, html, response_status) and stop.

    Below ``root``: ``catalogue`` and ``contents`` are appended to, ``report`` gets (batch, url, bucket). The number of
    buckets has to stay what it was in the first run.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a url that comes twice in a batch counts once: the page with the largest id
        newest = batch.join(batch.groupBy("url").agg(F.max("page_id").alias("page_id")), ["url", "page_id"], "left_semi").dropDuplicates(["url", "page_id"])
        home = bucket_of("url", buckets)
        touched = [r["home"] for r in newest.select(home.alias("home")).distinct().collect()]  # bucket numbers
        catalogue = touched_rows(spark, f"{root}/catalogue", CATALOGUE, touched, number).drop("bucket", "batch")
        contents = touched_rows(spark, f"{root}/contents", CONTENTS, touched, number).drop("bucket", "batch")
        read = extract_pages(newest, config, carry=("response_status",))
        body = F.coalesce("content", F.lit("")).alias("body")  # a page without text has the hash of ''
        fetched = read.select("page_id", "url", "response_status", body).withColumn("hash", F.sha2("body", 512))
        found = sync.classify_fetched(fetched, catalogue, contents).withColumn("home", home).persist()
        try:
            state = sync.fetch_status(F.col("response_status"))
            new = found.filter("bucket = 'new'")
            _write(new.select("url", F.col("page_id").alias("source_id"), state["source_status"].alias("status"), F.col("home").alias("bucket")), f"{root}/catalogue", number)
            versions = found.filter("bucket IN ('new', 'updated')").select(
                F.coalesce("source_id", "page_id").alias("source_id"),
                F.col("page_id").alias("content_id"),
                "hash",
                state["content_status"].alias("status"),
                F.lit(number).cast("long").alias("created_at"),
                F.col("home").alias("bucket"),
            )
            _write(versions, f"{root}/contents", number)
            found.select("url", "bucket").write.mode("overwrite").parquet(f"{root}/report/batch={number}")
        finally:
            found.unpersist()

    return (
        pages.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
