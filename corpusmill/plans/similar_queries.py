"""Near-duplicate vectors and texts."""

from pyspark.sql import functions as F

from corpusmill.operators import catalog as cat
from corpusmill.operators import similar
from corpusmill.plans.registry import query, table
from corpusmill.plans.text_queries import DEDUPE_SQL

# Components of the pairs above a threshold, by walking the links.
_WALK = """walk(node, reached) AS (SELECT a, a FROM edges UNION SELECT w.node, e.b FROM walk w JOIN edges e ON e.a = w.reached)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("payload"))


@query(
    "V7",
    f"""WITH RECURSIVE edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) > 0.42), {_WALK}
        SELECT node AS vec_id, min(reached) AS cluster FROM walk GROUP BY node""",
)
def near_duplicate_vector_clusters(spark, sf_dir):
    found = similar.near_duplicate_vectors(_vectors(spark, sf_dir), threshold=0.42)
    return found.select(F.col("item_id").alias("vec_id"), "cluster")


@query(
    "V7",
    f"""WITH RECURSIVE twice AS (SELECT vec_id * 10 AS id, embedding FROM embeddings UNION ALL SELECT vec_id * 10 + 3, embedding FROM embeddings),
          edges AS (SELECT x.id AS a, y.id AS b FROM twice x JOIN twice y ON x.id <> y.id
          WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) > 0.99), {_WALK}
        SELECT node AS item_id, min(reached) AS cluster FROM walk GROUP BY node""",
)
def copied_vector_clusters(spark, sf_dir):
    once = _vectors(spark, sf_dir)
    twice = once.select(F.explode(F.array(F.col("item_id") * 10, F.col("item_id") * 10 + 3)).alias("item_id"), "payload")
    return similar.near_duplicate_vectors(twice)


_ALTERED_SQL = "list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + 0.05 * ((vec_id + i - 1) % 3)))"


@query(
    "V7",
    f"""WITH RECURSIVE pairs AS (SELECT vec_id * 10 AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id * 10 + 3, {_ALTERED_SQL} FROM embeddings),
          edges AS (SELECT x.id AS a, y.id AS b FROM pairs x JOIN pairs y ON x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) > 0.99), {_WALK}
        SELECT node AS item_id, min(reached) AS cluster FROM walk GROUP BY node""",
)
def altered_vector_clusters(spark, sf_dir):
    """Every vector beside one whose coordinates are each up to a tenth longer."""
    once = _vectors(spark, sf_dir).withColumn("payload", F.col("payload").cast("array<double>"))
    altered = F.transform("payload", lambda x, i: x * (1 + 0.05 * ((F.col("item_id") + i) % 3)))
    twice = once.select(F.col("item_id") * 10, "payload").union(once.select(F.col("item_id") * 10 + 3, altered))
    return similar.near_duplicate_vectors(twice.toDF("item_id", "payload"))


_TFIDF = rf"""t AS (SELECT doc_id, {DEDUPE_SQL} AS text FROM documents),
    w AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM t) GROUP BY 1, 2),
    f AS (SELECT word, count(*) AS df, sum(tf) AS total FROM w GROUP BY 1),
    r AS (SELECT doc_id, word, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS raw FROM w JOIN f USING (word)),
    v AS (SELECT doc_id, word, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r),
    edges AS (SELECT x.doc_id AS a, y.doc_id AS b FROM v x JOIN v y ON x.word = y.word AND x.doc_id <> y.doc_id GROUP BY 1, 2 HAVING sum(x.weight * y.weight) > 0.8)"""


@query("V8", f"WITH RECURSIVE {_TFIDF}, {_WALK} SELECT node AS doc_id, min(reached) AS cluster FROM walk GROUP BY node")
def near_duplicate_text_clusters(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return similar.near_duplicate_texts(texts).select(F.col("item_id").alias("doc_id"), "cluster")


@query(
    "V8, T7",
    f"""SELECT doc_id AS item_id, min(doc_id) OVER (PARTITION BY k) AS cluster, count(*) OVER (PARTITION BY k) AS n_copies
        FROM (SELECT doc_id, {DEDUPE_SQL} AS k FROM documents) WHERE k <> '' QUALIFY count(*) OVER (PARTITION BY k) > 1""",
)
def exact_duplicate_texts(spark, sf_dir):
    return similar.exact_duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"))


@query(
    "A15",
    f"""WITH k AS (SELECT doc_id, source, {DEDUPE_SQL} AS k FROM documents), s AS (SELECT k, min(doc_id) AS cluster, count(*) AS cluster_size FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1)
        SELECT cluster, source, count(*) AS n, any_value(cluster_size) AS cluster_size FROM k JOIN s USING (k) GROUP BY cluster, source""",
)
def duplicate_members_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = similar.exact_duplicates(docs.select(F.col("doc_id").alias("item_id"), "text"))
    members = found.join(docs.select(F.col("doc_id").alias("item_id"), "source"), "item_id").select("cluster", "source")
    return cat.cluster_members(members)
