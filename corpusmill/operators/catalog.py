"""Relational operations over corpora, storages, sources, contents, chunks and reports.

Nothing here gathers a whole parent's children into one task: "latest" is an aggregate, "first n" is a
rank limit that Spark applies before the shuffle, and counts of several child tables are taken apart
before they meet their parents.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

# ---- predicates and projections ----


def matching(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns holds the text, whatever its case."""
    if not needle:
        return df
    wanted = F.lower(F.lit(needle))
    return df.filter(reduce(or_, [F.contains(F.lower(F.coalesce(c, F.lit(""))), wanted) for c in columns]))


def with_status(df: DataFrame, wanted: list[str], known: dict[str, str], column: str = "status") -> DataFrame:
    """Keep the asked statuses; unknown ones are ignored and none asked means no filter."""
    valid = [s for s in wanted if s in known]
    return df.filter(F.col(column).isin(valid)) if valid else df


def without_status(df: DataFrame, status: str, column: str = "status") -> DataFrame:
    return df.filter(~F.col(column).eqNullSafe(F.lit(status)))


def with_any_tag(sources: DataFrame, contents: DataFrame, tags: list[str]) -> DataFrame:
    """Sources that have one of the tags on any content version."""
    if not tags:
        return sources
    tagged = contents.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).select("source_id")
    return sources.join(tagged, "source_id", "left_semi")


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text) if text else None
    except ValueError:
        return None


def created_between(df: DataFrame, first: str | None, last: str | None, column: str = "created_at") -> DataFrame:
    """Inclusive range; an invalid date sets no bound and the last day counts up to its midnight."""
    if lower := _day(first):
        df = df.filter(F.col(column) >= F.lit(lower).cast("timestamp"))
    if upper := _day(last):
        df = df.filter(F.col(column) <= F.lit(upper).cast("timestamp"))
    return df


def with_body_length(sources: DataFrame, contents: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Sources having a version whose body length lies in the range; each source once."""
    fitting = contents.filter(F.length("body").between(shortest, longest)).select("source_id")
    return sources.join(fitting, "source_id", "left_semi")


def sort_columns(key: str | None, allowed: list[str], tie: str, default: str = "title") -> list[Column]:
    """Order by a known key ('-' in front means descending), else by the default; ties by id."""
    name = (key or "").lstrip("-")
    if name not in allowed:
        name, key = default, default
    first = F.desc(name) if key.startswith("-") else F.asc(name)
    return [first, F.asc(tie)]


def page_of(df: DataFrame, number: object, size: int, order: list[Column]) -> DataFrame:
    """One page of an ordered table: no number means the first page, past the end means the last.

    The first page is a top-n. A later one is cut out of the numbered rows, so what lies before it meets in no task.
    """
    try:
        wanted = int(number)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        wanted = 1
    last = max(1, -(-df.count() // size))
    at = min(max(wanted, 1), last) if wanted > 0 else last
    if at == 1:
        return df.orderBy(*order).limit(size)
    place = "_place"
    page = numbered(df, order, place).filter(F.col(place).between((at - 1) * size + 1, at * size))
    return page.orderBy(place).drop(place)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add the place of every row in an order, from 1: a range-partitioned sort and one count a partition.

    The ranges are written out before they are counted, since they are drawn from a sample.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for number in sorted(sizes):  # ranges are numbered in the order of their keys
        before[number], total = total, total + sizes[number]
    if not before:
        return ranged.withColumn(out, F.lit(0).cast("long")).drop("_range")
    skipped = F.element_at(F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*[F.lit(n).cast("long") for n in before.values()])), F.col("_range"))
    return ranged.withColumn(out, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + skipped).drop("_range")


def exact_quantile(df: DataFrame, keys: list[str], value: str, share: float, out: str) -> DataFrame:
    """(keys, out): the smallest value of a group up to which at least this share of its values lies; nulls do not count.

    Values are counted first. The counts are sorted by ranges, a group of any size over many tasks; the sums of the ranges
    tell in which one the group's place lies, and only that range is added up value by value.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = F.struct(*keys)
    ranged = counted.select(group.alias("_group"), F.col(value).alias(out), "_n").repartitionByRange("_group", out)
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_group", "_range").agg(F.sum("_n").alias("_sum"))  # a group has one row a range
    before = F.sum("_sum").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_sum")
    total = F.sum("_sum").over(Window.partitionBy("_group"))
    place = F.greatest(F.ceil(total * F.lit(share) - 1e-9), F.lit(1))
    found = sums.select("_group", "_range", "_sum", before.alias("_before"), place.alias("_place"))
    found = found.filter((F.col("_before") < F.col("_place")) & (F.col("_before") + F.col("_sum") >= F.col("_place")))
    running = F.col("_before") + F.sum("_n").over(Window.partitionBy("_group", "_range").orderBy(out))
    inside = ranged.join(found, ["_group", "_range"]).withColumn("_running", running)
    return inside.filter("_running >= _place").groupBy("_group").agg(F.min(out).alias(out)).select(*[F.col("_group")[k].alias(k) for k in keys], out)


def visible(df: DataFrame, mode: str = "live") -> DataFrame:
    """Soft deletion: 'live' hides deleted rows, 'deleted' shows only them, 'all' shows both."""
    if mode == "all":
        return df
    return df.filter(F.col("is_deleted") if mode == "deleted" else ~F.col("is_deleted"))


def owned_by(corpora: DataFrame, owners: DataFrame, user_id: int, superuser: bool = False) -> DataFrame:
    if superuser:
        return corpora
    return corpora.join(owners.filter(F.col("user_id") == user_id), "kb_id", "left_semi")


def chunks_of_corpus(chunks: DataFrame, paths: list[str], sources: DataFrame, storages: DataFrame, kb_id: int) -> DataFrame:
    """ACTIVE chunks that reach the corpus by any of their source columns."""
    in_corpus = storages.filter(F.col("kb_id") == kb_id).select("storage_id")
    reached = sources.join(in_corpus, "storage_id", "left_semi").select("source_id")
    active = chunks.filter(F.col("status") == "active").withColumn("source_id", F.coalesce(*paths))
    return active.join(reached, "source_id", "left_semi")


def not_exactly_one(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows breaking the rule that exactly one of the columns is set."""
    n_set = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.withColumn("n_set", n_set).filter("n_set <> 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row; rows with a NULL in the key are exempt."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def valid_score(score: Column, is_user: Column) -> Column:
    """Score of an answer as a whole number in -2..2, else NULL."""
    n = F.try_to_number(score, F.lit("S9")).cast("int")
    return F.when(~is_user & n.between(-2, 2), n)


# ---- parent and child tables ----


def latest_child(children: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """The newest child of every parent: one row each, decided by the order columns.

    A row number of 1 is a limit that Spark applies before the shuffle, so of each parent only the newest child of a
    task travels, whatever else its columns hold.
    """
    newest = Window.partitionBy(parent).orderBy(*[F.desc(c) for c in order])
    first = children.withColumn("_newest", F.row_number().over(newest)).filter("_newest = 1")
    return first.select(parent, *[c for c in children.columns if c != parent])


def latest_children(children: DataFrame, parent: str, at: str) -> DataFrame:
    """Every child made at its parent's newest time; ties are kept."""
    newest = children.groupBy(parent).agg(F.max(at).alias(at))
    return children.join(newest, [parent, at], "left_semi")


def first_children(children: DataFrame, parent: str, order: list[Column], n: int = 5) -> DataFrame:
    """At most n children per parent with their position. The limit is applied before the shuffle."""
    ranked = children.withColumn("position", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))
    return ranked.filter(F.col("position") <= n)


def with_children(parents: DataFrame, children: DataFrame, parent: str, order: list[Column], item: Column, n: int = 5) -> DataFrame:
    """Parents with the list of their first n children; no children gives an empty list."""
    few = first_children(children, parent, order, n).groupBy(parent).agg(
        F.array_sort(F.collect_list(F.struct("position", item.alias("item")))).alias("ranked")
    )
    return parents.join(few, parent, "left").withColumn(
        "children", F.coalesce(F.transform("ranked", lambda r: r["item"]), F.array())
    ).drop("ranked")


def child_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], missing: int | None = 0) -> DataFrame:
    """Distinct members of several child tables per parent, each counted before it is joined."""
    for name, (child, member) in children.items():
        counted = child.groupBy(key).agg(F.countDistinct(member).alias(name))
        parents = parents.join(counted, key, "left")
    return parents if missing is None else parents.fillna(missing, list(children))


def ancestry(contents: DataFrame, sources: DataFrame, storages: DataFrame, corpora: DataFrame) -> DataFrame:
    """Content with the names of everything above it."""
    named = storages.select("storage_id", "kb_id", F.col("name").alias("storage_name"))
    return (
        contents.join(sources.select("source_id", "storage_id", "title"), "source_id", "left")
        .join(named, "storage_id", "left")
        .join(corpora.select("kb_id", F.col("name").alias("kb_name")), "kb_id", "left")
        .withColumn("trail", F.concat_ws(" / ", "kb_name", "storage_name", "title", "content_id"))
    )


# ---- aggregates ----


def size_histogram(chunks: DataFrame) -> DataFrame:
    """ACTIVE chunks by size in tokens."""
    return (
        chunks.filter(F.col("status") == "active")
        .groupBy(F.col("size_in_tokens").cast("int").alias("size_in_tokens"))
        .agg(F.count("*").alias("n_chunks"))
    )


def tag_vocabulary(sources: DataFrame, depth: int, existing: DataFrame) -> DataFrame:
    """Distinct tags: the first ``depth`` of every source and the ones already known."""
    taken = sources.select(F.explode(F.slice("tags", 1, depth)).alias("tag")).distinct()
    return taken.union(existing.select("tag")).distinct()


def longest_tags(sources: DataFrame) -> DataFrame:
    """The longest tag chain of every storage; the lowest source id wins a tie."""
    chosen = F.max_by(F.struct("source_id", "tags"), F.struct(F.size("tags"), -F.col("source_id")))
    return sources.groupBy("storage_id").agg(chosen.alias("c")).select("storage_id", "c.source_id", "c.tags")


def job_outcomes(items: DataFrame, job: str, item: str, ok: Column) -> DataFrame:
    """One row per job, outcome and item: lists of any length without an unbounded cell."""
    return items.select(job, F.when(ok, "success").otherwise("failed").alias("outcome"), F.col(item).alias("item_id"))


def outcome_counts(outcomes: DataFrame, job: str) -> DataFrame:
    return outcomes.groupBy(job).agg(
        F.count_if(F.col("outcome") == "success").alias("n_success"),
        F.count_if(F.col("outcome") == "failed").alias("n_failed"),
    )


def cluster_members(members: DataFrame) -> DataFrame:
    """Members per source inside clusters of more than one: counted first, then sized."""
    counted = members.groupBy("cluster", "source").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("cluster").agg(F.sum("n").alias("cluster_size")).filter("cluster_size > 1")
    return counted.join(sizes, "cluster")


# ---- set operations ----


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def set_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Members added to and removed from a set."""
    added = missing_from(new.select(key), old, key).withColumn("change", F.lit("added"))
    removed = missing_from(old.select(key), new, key).withColumn("change", F.lit("removed"))
    return added.union(removed)
