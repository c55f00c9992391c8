"""Change capture: listings against the catalogue, change tasks, lifecycle and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.operators.catalog import latest_child


def classify_listing(listing: DataFrame, catalogue: DataFrame, full: bool = True) -> DataFrame:
    """(url, bucket): 'new', 'existing' and, when the listing is complete, 'deleted'.

    A partial listing says nothing about what it leaves out.
    """
    here = listing.select("url").distinct().withColumn("listed", F.lit(True))
    known = catalogue.select("url", "source_id", "status").withColumn("known", F.lit(True))
    joined = here.join(known, "url", "full_outer" if full else "left")
    bucket = F.when(F.col("known").isNull(), "new").when(F.col("listed").isNull(), "deleted").otherwise("existing")
    return joined.select("url", "source_id", "status", bucket.alias("bucket"))


def latest_hashes(contents: DataFrame) -> DataFrame:
    """Hash of the newest usable content of every source."""
    usable = contents.filter(F.col("status").isin("ready", "active"))
    newest = latest_child(usable.select("source_id", "content_id", "hash", "created_at"), "source_id", ["created_at", "content_id"])
    return newest.select("source_id", F.col("hash").alias("old_hash"), F.col("content_id").alias("old_content_id"))


def classify_fetched(fetched: DataFrame, catalogue: DataFrame, contents: DataFrame) -> DataFrame:
    """Fetched pages (url, hash, response_status, ...) against the catalogue.

    Adds source_id, old_hash and bucket, one of new, restored, excluded, skipped, updated.
    """
    known = catalogue.select("url", "source_id", F.col("status").alias("source_status"))
    joined = fetched.join(known, "url", "left").join(latest_hashes(contents), "source_id", "left")
    bucket = (
        F.when(F.col("source_id").isNull(), "new")
        .when(F.col("source_status") == "de", "restored")
        .when(F.col("source_status") == "ex", "excluded")
        .when(F.col("hash").eqNullSafe(F.col("old_hash")), "skipped")
        .otherwise("updated")
    )
    return joined.withColumn("bucket", bucket)


def fetch_status(response_status: Column) -> dict[str, Column]:
    """Status of a new source and of its content by the HTTP status."""
    good = F.coalesce(response_status == 200, F.lit(False))
    return {
        "source_status": F.when(good, "cr").otherwise("er"),
        "content_status": F.when(good, "ready").otherwise("error"),
    }


def new_versions(classified: DataFrame, report_id: int) -> DataFrame:
    """Content rows to append for new and changed pages."""
    status = fetch_status(F.col("response_status"))["content_status"]
    return classified.filter(F.col("bucket").isin("new", "updated")).select(
        "url", "source_id", "hash", "body", status.alias("status"), F.lit(report_id).cast("long").alias("report_id")
    )


def changed_files(current: DataFrame, contents: DataFrame) -> DataFrame:
    """Sources whose current hash differs from the newest usable one; none so far counts as changed."""
    joined = current.join(latest_hashes(contents), "source_id", "left")
    return joined.filter(~F.col("hash").eqNullSafe(F.col("old_hash")))


def change_tasks(changed: DataFrame) -> DataFrame:
    """A task per changed source whose status has a reason text; the source waits until it is resolved."""
    reasons = F.create_map(*[F.lit(x) for pair in fixed.CHANGE_REASON.items() for x in pair])
    described = changed.withColumn("description", F.try_element_at(reasons, F.col("status")))
    return described.filter(F.col("description").isNotNull()).select(
        "source_id",
        "old_content_id",
        F.col("content_id").alias("new_content_id"),
        F.lit("created").alias("status"),
        F.col("status").alias("previous_status"),
        "description",
    )


def resolve_sources(sources: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sources after their tasks: waiting while one is open, else the next status of the last one done."""
    closed = F.col("status").isin("solved", "rejected")
    verdict = tasks.groupBy("source_id").agg(
        F.count_if(F.col("status") == "created").alias("n_open"),
        F.max_by(F.when(closed, F.col("next_status")), F.when(closed, F.struct("finished_at", "task_id"))).alias("next"),
    )
    status = F.when(F.col("n_open") > 0, "wait").otherwise(F.coalesce("next", "status"))
    return sources.join(verdict, "source_id", "left").withColumn("status", status).drop("n_open", "next")


def activate(sources: DataFrame, contents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """Embedded chunks, the contents they come from and those contents' sources become active."""

    def activated(rows: DataFrame, key: str, hit: DataFrame) -> DataFrame:
        flags = hit.select(key).distinct().withColumn("_hit", F.lit(True))
        status = F.when(F.col("_hit"), "active").otherwise(F.col("status"))
        return rows.join(flags, key, "left").withColumn("status", status).drop("_hit")

    embedded = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_semi")
    reached = contents.join(embedded.select("content_id"), "content_id", "left_semi")
    return {
        "chunks": activated(chunks, "chunk_id", embedded),
        "contents": activated(contents, "content_id", embedded),
        "sources": activated(sources, "source_id", reached),
    }


def replace_derived(existing: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Derived rows with the old ones of the same key left out."""
    kept = existing.join(derived.select(key).distinct(), key, "left_anti")
    return kept.unionByName(derived)


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per natural key: the latest incoming row, else the existing one."""
    ranked = existing.withColumn("_rank", F.struct(F.lit(0).alias("side"), F.col(order).alias("at"))).unionByName(
        incoming.withColumn("_rank", F.struct(F.lit(1).alias("side"), F.col(order).alias("at")))
    )
    rest = [c for c in existing.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.col("_rank")).alias("row")
    return ranked.groupBy(*key).agg(newest).select(*key, "row.*")


def cascade_deletion(parents: DataFrame, children: DataFrame, key: str, at: Column) -> DataFrame:
    """Children of a deleted parent are deleted with it; those of a restored one come back.

    ``parents`` carries ``action``: 'delete', 'restore' or NULL for untouched.
    """
    joined = children.join(parents.filter("action IS NOT NULL").select(key, "action"), key, "left")
    deleted = F.when(F.col("action") == "delete", F.lit(True)).when(F.col("action") == "restore", F.lit(False))
    stamp = F.when(F.col("action") == "delete", at).when(F.col("action").isNull(), F.col("deleted_at"))
    return joined.withColumns(
        {"is_deleted": F.coalesce(deleted, F.col("is_deleted")), "deleted_at": stamp}
    ).drop("action")


def field_changes(old: DataFrame, new: DataFrame, key: str, ignored: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """JSON {field: {from, to}} for every row changed between two versions of a table."""
    fields = [c for c in old.columns if c != key and c not in ignored]
    before = old.select(key, F.struct(*fields).alias("before"))
    after = new.select(key, F.struct(*fields).alias("after"))
    entries = F.array(
        *[
            F.when(
                ~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")),
                F.struct(
                    F.lit(f).alias("key"),
                    F.struct(
                        F.col(f"before.{f}").cast("string").alias("from"), F.col(f"after.{f}").cast("string").alias("to")
                    ).alias("value"),
                ),
            )
            for f in fields
        ]
    )
    changed = before.join(after, key).select(key, F.filter(entries, lambda e: e.isNotNull()).alias("entries"))
    return changed.filter(F.size("entries") > 0).select(
        key, F.lit("update").alias("action"), F.to_json(F.map_from_entries("entries")).alias("changes")
    )


def report_items(classified: DataFrame, report_id: int, item: str) -> DataFrame:
    """Long form of a run's report: a row per item, so that no bucket has to fit into one cell."""
    return classified.select(F.lit(report_id).cast("long").alias("report_id"), "bucket", F.col(item).alias("item_id"))


def report_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("report_id", "bucket").agg(F.count("*").alias("n_items"))
