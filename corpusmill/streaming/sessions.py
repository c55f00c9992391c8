"""Per-session accumulated facts as a stream: the twin of ``chat.fact_items``.

The state of a fact may begin from a batch table and leaves again when its fact has not been said for a while. It lies in
buckets by fact, so that a session of any size is spread over all tasks. A batch reads the buckets of its own facts and
writes them anew, without what has left; no row meets Python.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

FACTS = "session_id long, name string, item string, turn long, pos long"
STATE = f"{FACTS}, said long, changed boolean"
KEY = ["session_id", "name", "item"]
KEEP_MS = 30 * 24 * 3600 * 1000
BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that wrote this bucket."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _forget(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _row(bucket: Column, new: Column, was: Column, said: Column) -> list[Column]:
    return [F.col(k) for k in KEY] + [bucket.alias("bucket"), new.alias("new"), was.alias("was"), said.alias("said")]


def keep_facts(facts: DataFrame, root: str, known: DataFrame | None = None, keep_ms: int = KEEP_MS, buckets: int = BUCKETS) -> StreamingQuery:
    """Run over what is new in a stream of (session_id, turn, name, value array<string>) and stop.

    Below ``root``: ``changes`` gets the facts that are new or turn up at an earlier place, a folder a batch; ``state`` is
    where they were first said. What has left the state is a change again when it is said again; the earlier row of the
    changes still holds its first place. ``known``: rows of FACTS that the state begins from, read by the first batch only.
    ``keep_ms``: how long a fact that is not said again is held. The number of buckets has to stay what it was in the first run.
    """
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
    place = F.struct(F.col("turn").cast("long").alias("turn"), F.col("pos").cast("long").alias("pos"))
    no_place, no_time = F.lit(None).cast("struct<turn:bigint,pos:bigint>"), F.lit(None).cast("long")

    def one_batch(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, time.time_ns() // 1_000_000
        items = batch.select(F.col("session_id").cast("long").alias("session_id"), "name", "turn", F.posexplode("value").alias("pos", "item"))
        rows = items.filter("item <> ''").select(*_row(bucket, place, no_place, no_time))
        before: dict[int, list[int]] = {}
        if number == 0 and known is not None:
            rows = rows.unionByName(known.select(*_row(bucket, no_place, place, F.lit(now))))
        elif number:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # bucket numbers
            found = {b: [v for v in _versions(spark, f"{root}/state/bucket={b}") if v < number] for b in touched}
            before = {b: versions for b, versions in found.items() if versions}
        if before:
            state = spark.read.schema(STATE).parquet(*[f"{root}/state/bucket={b}/batch={v[-1]}" for b, v in before.items()])
            held = state.filter(F.col("said") + keep_ms > now)
            rows = rows.unionByName(held.select(*_row(bucket, no_place, place, F.col("said"))))
        met = rows.groupBy("bucket", *KEY).agg(F.min("new").alias("new"), F.min("was").alias("was"), F.max("said").alias("said"))
        changed = F.col("new").isNotNull() & (F.col("was").isNull() | (F.col("new") < F.col("was")))
        first = F.when(changed, F.col("new")).otherwise(F.col("was"))
        said = F.when(F.col("new").isNotNull(), F.lit(now)).otherwise(F.col("said"))
        after = met.select(*KEY, first["turn"].alias("turn"), first["pos"].alias("pos"), said.alias("said"), changed.alias("changed"), "bucket")
        after = after.withColumn("batch", F.lit(number).cast("long")).repartition("bucket")
        # into the folder of every bucket and this batch: a repeated batch replaces its own rows only
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{root}/state")
        written = spark.read.schema(f"{STATE}, bucket int, batch long").parquet(f"{root}/state").filter(F.col("batch") == number)
        written.filter("changed").select(*KEY, "turn", "pos").write.mode("overwrite").parquet(f"{root}/changes/batch={number}")
        for b, versions in before.items():  # the one that was read stays, for a repeated batch
            for v in versions[:-1]:
                _forget(spark, f"{root}/state/bucket={b}/batch={v}")

    return (
        facts.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current_facts(changes: DataFrame) -> DataFrame:
    """The facts as they stand after all changes."""
    first = F.min(F.struct("turn", "pos")).alias("first")
    return changes.groupBy(*KEY).agg(first)
