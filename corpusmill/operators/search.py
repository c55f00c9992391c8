"""Retrieval: exact nearest neighbours, reranking, rank fusion and context assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions.text import strip, text_key
from corpusmill.operators.vector_cells import top_k

def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, per_storage: bool = False, **limits) -> DataFrame:
    """Exact k nearest by squared L2: query_id, chunk_id, storage_id, distance, rank.

    ``vectors``: chunk_id, storage_id, embedding. ``queries``: query_id, embedding. With
    ``per_storage`` every storage gives its own k.
    """
    key = F.col("storage_id").cast("string") if per_storage else F.lit("")
    corpus = vectors.select(key.alias("partition_key"), F.col("chunk_id").alias("item_id"), F.col("embedding").alias("payload"))
    asked = queries.select("query_id", F.col("embedding").alias("payload"))
    hits = top_k(corpus, asked, k, **limits)
    return hits.select(
        "query_id",
        F.col("item_id").alias("chunk_id"),
        F.col("partition_key").alias("storage_id"),
        F.col("cost").alias("distance"),
        "rank",
    )


def nearest_in_default_storage(vectors: DataFrame, storages: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Search only the storages flagged as default; none flagged is an error."""
    default = storages.filter("default_retriever").select("storage_id")
    if default.isEmpty():
        raise ValueError("no storage is flagged as default retriever")
    return nearest(vectors.join(default, "storage_id", "left_semi"), queries, k)


def rerank(hits: DataFrame, score: Column, threshold: float = 0.8, relax: float = 0.4, top_n: int = 5) -> DataFrame:
    """Hits closer than the threshold, or than the relaxed one where a query has none, best score first.

    ``hits`` holds at most k rows per query.
    """
    per_query = Window.partitionBy("query_id")
    near = F.max(F.when(F.col("distance") < threshold, F.lit(1))).over(per_query)
    bound = F.when(near.isNotNull(), F.lit(threshold)).otherwise(F.lit(threshold + relax))
    kept = hits.withColumn("rerank_score", score).withColumn("_bound", bound).filter(F.col("distance") < F.col("_bound"))
    order = per_query.orderBy(F.desc("rerank_score"), "distance", "chunk_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n).drop("_bound")


def fuse(ranked: list[tuple[DataFrame, float]], key: str = "chunk_id", constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, key, rank) lists."""
    weighted = [
        hits.select("query_id", key, (F.lit(float(w)) / (F.col("rank") + constant)).alias("_w")) for hits, w in ranked
    ]
    fused = reduce(DataFrame.union, weighted).groupBy("query_id", key).agg(F.sum("_w").alias("score"))
    return fused.withColumn("score", F.round("score", 9))


def fuse_texts(ranked: list[tuple[DataFrame, float]], top_k: int | None = None) -> DataFrame:
    """Fusion of (query_id, chunk_id, distance, rank, page_content, ...) lists in which one text counts once per query.

    A text under several ids keeps the row of its nearest chunk, with the fused score and its new rank; ``top_k`` cuts
    after the fusion.
    """
    keyed = [(hits.withColumn("_text", text_key(F.col("page_content"))), weight) for hits, weight in ranked]
    fused = fuse(keyed, key="_text")
    rows = reduce(DataFrame.unionByName, [hits.drop("rank") for hits, _ in keyed])
    nearest_first = Window.partitionBy("query_id", "_text").orderBy("distance", "chunk_id")
    once = rows.withColumn("_r", F.row_number().over(nearest_first)).filter("_r = 1").join(fused, ["query_id", "_text"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "chunk_id")
    best = once.withColumn("rank", F.row_number().over(order)).drop("_r", "_text")
    return best if top_k is None else best.filter(F.col("rank") <= top_k)


def contexts(hits: DataFrame, text: str = "page_content") -> DataFrame:
    """One text per query: its numbered excerpts in rank order. ``hits`` holds at most k rows per query."""
    excerpts = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text"))))
    numbered = F.transform(
        excerpts,
        lambda x, i: F.concat(F.lit(fixed.EXCERPT_HEADING), (i + 1).cast("string"), F.lit("\n"), x["text"]),
    )
    return hits.groupBy("query_id").agg(F.array_join(numbered, "\n").alias("context"))


# Headings of the link sections in a context, by metadata prefix.
LINK_SECTIONS = {
    "internal_links__": "[Внутренние ссылки по теме]:",
    "external_links__": "[Ссылки на внешние ресурсы]:",
    "files__images__": "[Изображения]:",
    "files__documents__": "[Документы]:",
}


def link_sections(metadata: Column) -> Column:
    """Text block of the links of a chunk grouped by kind; '' when it has none."""

    def section(prefix: str, heading: str) -> Column:
        values = F.map_values(F.map_filter(metadata, lambda k, v: k.startswith(prefix) & v.isNotNull()))
        lines = F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")
        return F.when(F.size(values) > 0, F.concat(F.lit(f"\n{heading}\n"), lines)).otherwise("")

    return F.concat(*[section(*pair) for pair in LINK_SECTIONS.items()])


def excerpt_with_links(number: Column, text: Column, metadata: Column) -> Column:
    head = F.concat(F.lit("Отрывок документа №"), number.cast("string"), F.lit("\n=====================\n"), text)
    return strip(F.concat(head, F.lit("\n"), link_sections(metadata)))


def with_placeholder(queries: DataFrame, results: DataFrame, column: str = "context") -> DataFrame:
    """Every query with its result, or with a fixed text when it found nothing."""
    joined = queries.select("query_id").join(results, "query_id", "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(fixed.NO_RESULT_TEXT)))
