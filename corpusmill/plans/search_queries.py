"""Vector and trigram retrieval; every vector and every benchmark text is a query."""

from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions.meta import link_fields
from corpusmill.functions.text import shared_words
from corpusmill.operators import search, trigram_index
from corpusmill.plans.registry import lit, query, table
from corpusmill.plans.text_queries import TRIGRAMS_SQL


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("storage_id"), "embedding"
    )


def asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


PAIRS_SQL = """WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label AS storage_id, q.label AS q_label,
    round(pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2), 6) AS distance FROM embeddings q, embeddings v) """


def knn_sql(k: int) -> str:
    return PAIRS_SQL + f""", knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM pairs
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= {k}) """


@query("V2, K3, K4, W4", knn_sql(5) + "SELECT query_id, chunk_id, distance, rank FROM knn")
def nearest_vectors(spark, sf_dir):
    hits = search.nearest(vectors(spark, sf_dir), asked(spark, sf_dir), k=5)
    return hits.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


@query("V2, K4", knn_sql(10) + "SELECT query_id, chunk_id, distance, rank FROM knn")
def nearest_vectors_by_query_blocks(spark, sf_dir):
    """Many small blocks give the same hits."""
    hits = search.nearest(vectors(spark, sf_dir), asked(spark, sf_dir), k=10, block_bytes=100_000)
    return hits.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


@query(
    "V3, K3",
    knn_sql(10)
    + """, b AS (SELECT *, CASE WHEN min(distance) OVER (PARTITION BY query_id) < 0.3 THEN 0.3 ELSE 0.3 + 1.2 END AS bound FROM knn WHERE chunk_id <> query_id),
         r AS (SELECT *, -abs(q_label - storage_id) AS score FROM b WHERE distance < bound)
         SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, chunk_id) AS rank FROM r
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, chunk_id) <= 5""",
)
def reranked_hits(spark, sf_dir):
    hits = search.nearest(vectors(spark, sf_dir), asked(spark, sf_dir), k=10).filter("chunk_id <> query_id")
    labels = table(spark, sf_dir, "embeddings")
    hits = hits.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    hits = hits.join(labels.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("c_label")), "chunk_id")
    score = -F.abs(F.col("q_label") - F.col("c_label"))
    best = search.rerank(hits, score, threshold=0.3, relax=1.2)
    return best.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


@query(
    "V4, W4",
    PAIRS_SQL
    + """, per AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id, storage_id ORDER BY distance, chunk_id) AS r FROM pairs
           QUALIFY row_number() OVER (PARTITION BY query_id, storage_id ORDER BY distance, chunk_id) <= 2),
         one AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS r FROM pairs
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 5)
         SELECT query_id, chunk_id, round(sum(w), 9) AS score FROM (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + r) AS w FROM per
           UNION ALL SELECT query_id, chunk_id, 0.5::DOUBLE / (60 + r) FROM one) GROUP BY 1, 2""",
)
def fused_rankings(spark, sf_dir):
    v, q = vectors(spark, sf_dir), asked(spark, sf_dir)
    per_storage = search.nearest(v, q, k=2, per_storage=True)
    overall = search.nearest(v, q, k=5)
    return search.fuse([(per_storage, 1.0), (overall, 0.5)])


@query(
    "V4",
    PAIRS_SQL
    + """, h AS (SELECT query_id, chunk_id, distance, 'text ' || chunk_id % 50 AS page_content, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS r
           FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 8),
         f AS (SELECT query_id, page_content, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, arg_min(chunk_id, (distance, chunk_id)) AS chunk_id, min(distance) AS distance FROM h GROUP BY 1, 2)
         SELECT query_id, page_content, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, chunk_id) AS rank FROM f
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, chunk_id) <= 4""",
)
def fused_texts(spark, sf_dir):
    """One text stands under several chunk ids; it is ranked once, by the sum of its ranks."""
    hits = search.nearest(vectors(spark, sf_dir), asked(spark, sf_dir), k=8)
    hits = hits.withColumn("page_content", F.concat(F.lit("text "), F.col("chunk_id") % 50))
    best = search.fuse_texts([(hits, 1.0)], top_k=4)
    return best.select("query_id", "page_content", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "V5",
    PAIRS_SQL
    + """SELECT query_id, chunk_id, distance FROM pairs WHERE storage_id IN (2, 5)
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 5""",
)
def hits_in_default_storage(spark, sf_dir):
    v = vectors(spark, sf_dir)
    storages = v.select("storage_id").distinct().withColumn("default_retriever", F.col("storage_id").isin(2, 5))
    return search.nearest_in_default_storage(v, storages, asked(spark, sf_dir)).select("query_id", "chunk_id", "distance")


_TRIGRAM_SQL = f"""WITH d AS (SELECT doc_id, {TRIGRAMS_SQL.format('text')} AS g FROM documents),
    b AS (SELECT item_id, {TRIGRAMS_SQL.format('text')} AS g FROM benchmark),
    dt AS (SELECT doc_id, unnest(g) AS t FROM d), bt AS (SELECT item_id, unnest(g) AS t FROM b),
    s AS (SELECT item_id, doc_id, count(*) AS n FROM bt JOIN dt USING (t) GROUP BY 1, 2),
    sim AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, round(coalesce(n, 0)::DOUBLE / (len(b.g) + len(d.g) - coalesce(n, 0)), 6) AS similarity
      FROM b CROSS JOIN d LEFT JOIN s ON s.item_id = b.item_id AND s.doc_id = d.doc_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sim
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) <= 10) """


def trigram_hits(spark, sf_dir, **options):
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("page_content")
    )
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return chunks, queries, trigram_index.trigram_search(chunks, queries, **options)


@query("V6, T23, K4", _TRIGRAM_SQL + "SELECT query_id, chunk_id, similarity, rank FROM top")
def trigram_matches(spark, sf_dir):
    hits = trigram_hits(spark, sf_dir)[2]
    return hits.withColumn("rank", F.col("rank").cast("long"))


_SHARED_SQL = """round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}\\p{N}]+')), list_distinct(regexp_extract_all(lower(c.text), '[\\p{L}\\p{N}]+'))))::DOUBLE
    / len(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}\\p{N}]+'))), 6)"""


@query(
    "V6, V3, P2",
    _TRIGRAM_SQL.replace("FROM documents)", "FROM documents WHERE doc_id % 3 <> 0)")
    + f""", r AS (SELECT query_id, chunk_id, similarity, {_SHARED_SQL} AS rerank_score,
             CASE WHEN min(similarity) OVER (PARTITION BY query_id) < 0.8 THEN 0.8 ELSE 0.8 + 0.4 END AS bound
           FROM top JOIN benchmark q ON item_id = query_id JOIN documents c ON doc_id = chunk_id)
         SELECT query_id, chunk_id, similarity, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, similarity, chunk_id) AS rank
         FROM r WHERE similarity < bound QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, similarity, chunk_id) <= 5""",
)
def reranked_trigram_matches(spark, sf_dir):
    """Trigram hits among ACTIVE chunks, put in order by the words that question and chunk share."""
    status = F.when(F.col("doc_id") % 3 == 0, "ready").otherwise("active")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("page_content"), status.alias("status"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = trigram_index.reranked_matches(chunks, queries, shared_words)
    return best.withColumn("rank", F.col("rank").cast("long"))


@query(
    "V14, V15",
    _TRIGRAM_SQL
    + f""", c AS (SELECT query_id, string_agg('Документ ' || rank || chr(10) || text, chr(10) ORDER BY rank) AS context
           FROM top JOIN documents ON doc_id = chunk_id WHERE similarity >= 0.4 GROUP BY 1)
         SELECT item_id AS query_id, coalesce(context, {lit(fixed.NO_RESULT_TEXT)}) AS context FROM benchmark LEFT JOIN c ON query_id = item_id""",
)
def answer_contexts(spark, sf_dir):
    chunks, queries, hits = trigram_hits(spark, sf_dir, threshold=0.4)
    return search.with_placeholder(queries, search.contexts(hits.join(chunks, "chunk_id")))


@query(
    "V14",
    """SELECT doc_id, 'Отрывок документа №' || doc_id || chr(10) || '=====================' || chr(10) || text || chr(10) || chr(10) ||
         '[Ссылки на внешние ресурсы]:' || chr(10) || '- ' || source || ' http://' || source AS excerpt FROM documents""",
)
def excerpts_with_links(spark, sf_dir):
    url = F.concat(F.lit("http://"), "source")
    links = F.array(F.struct(F.col("source").alias("text"), url.alias("url")))
    excerpt = search.excerpt_with_links(F.col("doc_id"), F.col("text"), link_fields(links, "external_links"))
    return table(spark, sf_dir, "documents").select("doc_id", excerpt.alias("excerpt"))
