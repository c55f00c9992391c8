"""The library's flows end to end: ingest pages, chunk and embed, answer a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.meta import append_materials, append_source_url
from corpusmill.operators import chunking, embed, search, sync
from corpusmill.operators.pages import PageConfig, extract_pages
from corpusmill.session import cut_lineage


def ingest(pages: DataFrame, catalogue: DataFrame, contents: DataFrame, config: PageConfig = PageConfig()) -> DataFrame:
    """Raw pages (page_id, url, html, response_status) to content rows with their sync bucket."""
    rows = extract_pages(pages, config, carry=("response_status",))
    fetched = rows.withColumnRenamed("content", "body").withColumn("hash", F.sha2("body", 512))
    return sync.classify_fetched(fetched, catalogue, contents)


def chunk_and_embed(contents: DataFrame, splitter: str, config: dict, engine: str, model) -> tuple[DataFrame, DataFrame]:
    """Chunks of (content_id, storage_id, body, metadata) and their vectors.

    A chunk id is a hash of content and position, so a repeated run gives the same ids.
    """
    chunks = chunking.chunk_contents(chunking.usable(contents), splitter, config, carry=("storage_id",))
    # read for the vectors and for the contexts: written out, so every text is split once
    chunks = cut_lineage(chunks.withColumn("chunk_id", F.xxhash64("content_id", "ordinal")))
    # a search reads its vectors several times: written out, so the model sees every chunk once
    return chunks, cut_lineage(embed.embed_chunks(chunks, engine, model))


def answer_contexts(
    questions: DataFrame, question_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 2, top_k: int = 10
) -> DataFrame:
    """Context of every question: nearest chunks per storage, fused by text, the ``top_k`` best, with links and source lines."""
    per_storage = search.nearest(vectors, question_vectors, k=k, per_storage=True)
    text = append_source_url(append_materials(F.col("page_content"), F.col("metadata")), F.col("metadata")["url"])
    found = cut_lineage(per_storage.join(chunks.select("chunk_id", text.alias("page_content")), "chunk_id"))
    hits = search.fuse_texts([(found, 1.0)], top_k)
    return search.with_placeholder(questions, search.contexts(hits))
