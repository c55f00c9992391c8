"""Exact dedup: a persistent index of text digests, bucketed and sorted by digest.

New rows are reduced to one winner a digest. A sort-merge anti-join with the index, which needs no shuffle of the index,
finds the digests that are new; they are appended. Digests that the index holds are appended to a second table of repeats,
so that group sizes add up over all batches. Everything is DataFrame operations.

The index lives in a folder and can be opened again under any settings. A batch counts from the moment its commit is
written; what a failed attempt left behind is never read, and a batch of a name that is committed is not added again.

Null texts count as empty, and all empty texts are equal. Of equal texts the largest doc_id stays, over all batches (a null
id loses to any other); of repeated rows with the same id, the first one of the earliest batch. Empty tables give empty
results. Extra columns, clashing names included, pass through ``unique_rows``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, shared_path, stored, whole_text
from corpusmill.sources import buckets

ENTRY = "digest STRING, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, attempt STRING"
COMMIT = "attempt STRING, batch STRING, number BIGINT"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest) of every row. ``row`` numbers the rows as they were read; store the result before use."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.sha2(whole_text(), 256).alias("digest"))


def _order(keep_id: Column, number: Column, row: Column) -> Column:
    """The largest of these stays: by id, then the earliest batch and row."""
    return F.struct(keep_id.alias("keep_id"), (-number).alias("number"), (-row).alias("row"))


class DigestIndex:
    """The digests seen so far, with the row that stays for each of them and how many rows had it."""

    def __init__(self, spark: SparkSession, path: str | None = None, n_buckets: int | None = None):
        """Open the index at a path, or begin one where there is none; its number of buckets stays what it was made with."""
        self.spark, self.path = spark, path or shared_path(spark, "digest-index")
        self.seen, self.repeated, self.log = f"{self.path}/digests", f"{self.path}/repeats", f"{self.path}/commits"
        n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for table in (self.seen, self.repeated):
            if buckets.manifest_of(spark, table) is None:
                buckets.create(spark, table, ENTRY, "digest", "digest", n_buckets)
        if buckets.manifest_of(spark, self.log) is None:
            buckets.create(spark, self.log, COMMIT, "attempt", "number", 1)

    def commits(self) -> DataFrame:
        """(attempt, batch, number): one row a batch."""
        return buckets.rows_of(self.spark, self.log)

    def _committed(self, table: str) -> DataFrame:
        return buckets.rows_of(self.spark, table).join(F.broadcast(self.commits().select("attempt", "number")), "attempt")

    def add(self, batch: DataFrame, name: str | None = None) -> int:
        """Take in a stored batch of digests and return its number.

        A name that was committed before stands for the same rows again: nothing is added. Without a name the rows are new
        ones, whatever they hold.
        """
        name = name or uuid.uuid4().hex
        done = self.commits()
        again = done.where(F.col("batch") == name).first()
        if again:
            return again["number"]
        attempt, number = uuid.uuid4().hex, done.count()
        best = F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("row"))).alias("best")
        winners = batch.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
        winners = winners.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.row")).alias("keep_row"), "group_size", F.lit(attempt).alias("attempt"))
        held = self._committed(self.seen).select("digest").hint("merge")
        buckets.append(winners.join(held, "digest", "left_anti"), self.seen)
        buckets.append(winners.join(held, "digest", "left_semi"), self.repeated)
        commit = self.spark.range(1, numPartitions=1).select(F.lit(attempt).alias("attempt"), F.lit(name).alias("batch"), F.lit(number).cast("long").alias("number"))
        buckets.append(commit, self.log)
        return number

    def entries(self) -> DataFrame:
        """digest, keep_id, keep_number, keep_row, group_size, first_number: one row a digest over all batches."""
        rows = self._committed(self.seen).unionByName(self._committed(self.repeated))
        found = rows.groupBy("digest").agg(
            F.max(_order(F.col("keep_id"), F.col("number"), F.col("keep_row"))).alias("best"), F.sum("group_size").alias("group_size"), F.min("number").alias("first_number")
        )
        return found.select("digest", F.col("best.keep_id").alias("keep_id"), (-F.col("best.number")).alias("keep_number"), (-F.col("best.row")).alias("keep_row"), "group_size", "first_number")


def by_ids(batch: DataFrame) -> list[DataFrame]:
    """Two batches of about equal size, the larger ids first; a null id is the smallest."""
    middle = batch.agg(F.percentile_approx("doc_id", F.lit(0.5))).first()[0]
    larger = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    return [batch.where(larger), batch.where(~larger)]


def _taken_in(docs: DataFrame, index: DigestIndex, name: str | None) -> DataFrame:
    """The batch's digests with the number of the batch each row came in."""
    rows, name = stored(digests(docs), "digests"), name or uuid.uuid4().hex
    parts = [part.withColumn("number", F.lit(index.add(part, f"{name}/{i}")).cast("long")) for i, part in enumerate(by_ids(rows))]
    return reduce(DataFrame.unionByName, parts)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, name: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too, judged by all that the index has seen.

    ``name``: of the batch, for callers that may give it again after a failure. The entries are written out before they are
    joined: a join of two shuffled sides lets Spark split a digest that very many rows share, a bucketed side would not.
    """
    index = index or DigestIndex(docs.sparkSession)
    rows = _taken_in(docs, index, name)
    found = rows.join(stored(index.entries(), "digest-entries").hint("merge"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("number") == F.col("keep_number")) & (F.col("row") == F.col("keep_row"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def unique_rows(docs: DataFrame, index: DigestIndex | None = None, name: str | None = None) -> DataFrame:
    """The rows whose texts the index had not seen before, one a text, with all their columns.

    Digest and id together are the key of the last join, so a digest with very many copies is no hot key there; the
    texts are shuffled once, and repeated rows of one id meet on that same shuffle.
    """
    index = index or DigestIndex(docs.sparkSession)
    numbers = _taken_in(docs, index, name).select("number").distinct()  # of two batches at most
    key = fresh(docs, "dedup_key")
    label = lambda digest, doc_id: F.concat_ws(":", digest, F.coalesce(doc_id.cast("string"), F.lit("")))
    new = index.entries().join(F.broadcast(numbers.withColumnRenamed("number", "first_number")), "first_number", "left_semi")
    winners = stored(new.select(label(F.col("digest"), F.col("keep_id")).alias(key)), "digest-winners")
    marked = docs.withColumn(key, label(F.sha2(whole_text(), 256), F.col("doc_id")))
    return marked.join(winners.hint("merge"), key, "left_semi").dropDuplicates([key]).drop(key)


DEDUPLICATE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
