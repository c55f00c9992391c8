"""Readers and writers over the driver's tables."""

from pyspark.sql import functions as F

from corpusmill.operators import chunking, embed, search
from corpusmill.plans import flows
from corpusmill.plans.catalog_queries import LABELS_SQL
from corpusmill.plans.chunk_queries import WINDOWS_SQL
from corpusmill.plans.registry import query, table
from corpusmill.plans.search_queries import knn_sql
from corpusmill.plans.standins import standin
from corpusmill.session import shared_path
from corpusmill.sources import readers, writers



@query(
    "S3",
    """SELECT page_id, url FROM pages UNION ALL SELECT page_id, CASE WHEN html LIKE '%lang="en"%' THEN 'https://b.example.com/' || page_id
       ELSE 'http://c.example.com/' || page_id END FROM pages""",
)
def parsed_url_lists(spark, sf_dir):
    listed = F.concat(
        F.lit('["'), "url", F.lit('", "ftp://x/'), "page_id", F.lit('", "https://b.example.com/'), "page_id", F.lit('"]')
    )
    typed = F.concat("url", F.lit(" ;\nno url, http://c.example.com/"), "page_id", F.lit("\n"))
    raw = F.when(F.col("html").contains('lang="en"'), listed).otherwise(typed)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(readers.url_list(raw)).alias("url"))


@query(
    "S4",
    r"""SELECT conv_id, turn, trim(regexp_replace(q, '^\s+|\s+$', '', 'g')) AS question FROM
        (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS q FROM conversations) WHERE trim(regexp_replace(q, '^\s+|\s+$', '', 'g')) <> ''
        UNION ALL SELECT conv_id, turn, role FROM conversations""",
)
def question_lists(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    lines = talk.select("conv_id", "turn", F.explode(readers.question_lines(F.col("text"))).alias("question"))
    csv = F.concat(F.lit(' "'), "role", F.lit('";second;third\n;x\n'))
    cells = talk.select("conv_id", "turn", F.explode(readers.csv_questions(csv)).alias("question"))
    return lines.union(cells)


@query(
    "S6",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'layer' WHEN lang IN ('fr', 'de') THEN 'scan' END AS method,
         CASE WHEN lang = 'en' THEN text WHEN lang IN ('fr', 'de') THEN upper(source) END AS text,
         CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'no text recognised' END AS error FROM documents""",
)
def best_extracted_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.select("doc_id", F.lit("layer").alias("method"), F.lit(1).alias("priority"),
                        F.when(F.col("lang") == "en", F.col("text")).otherwise(" \n").alias("text"))
    second = docs.select("doc_id", F.lit("scan").alias("method"), F.lit(2).alias("priority"),
                         F.when(F.col("lang") != "es", F.upper("source")).alias("text"))
    return readers.best_text(docs.select("doc_id"), first.union(second))


@query(
    "S9, P10",
    f"""SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '' END AS description,
          '/files/' || o_orderkey AS path, 'http://host/' || o_orderkey AS link, CASE WHEN o_orderstatus = 'P' THEN 'file' ELSE 'text' END AS format,
          {LABELS_SQL.format("CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'ready' ELSE 'xx' END")} AS status FROM orders""",
)
def catalogue_export_rows(spark, sf_dir):
    documents = standin(spark, sf_dir, "sources").select(
        "source_id", "title", F.when(F.col("status") == "active", F.col("title")).alias("description"),
        F.concat(F.lit("/files/"), "source_id").alias("path"), "url",
        F.when(F.col("status") == "xx", "f").otherwise("t").alias("output_format"), "status",
    )
    return writers.catalogue_rows(documents)


@query(
    "S7, C7, C10",
    f"""WITH {WINDOWS_SQL} SELECT source AS storage_id, count(*) AS n_chunks, sum(length(page_content))::BIGINT AS n_chars, max(ordinal)::BIGINT AS last
        FROM windows JOIN documents USING (doc_id) GROUP BY source""",
)
def appended_chunks(spark, sf_dir):
    """Chunks appended in two jobs, each run twice, and read back from the table, partitioned by storage."""
    path = shared_path(spark, "chunks")
    contents = _documents(spark, sf_dir)
    for even in (True, False):
        part = contents.filter((F.col("content_id") % 2 == 0) if even else (F.col("content_id") % 2 != 0))
        for _ in range(2):
            writers.append_chunks(chunking.chunk_contents(part, "window", {}, carry=("storage_id",)), path, job=f"even={even}")
    stored = spark.read.parquet(path)
    return stored.groupBy("storage_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("page_content")).alias("n_chars"), F.max("ordinal").cast("long").alias("last")
    )


@query("S8, C7", f"WITH {WINDOWS_SQL} SELECT doc_id AS content_id, ordinal, page_content FROM windows")
def exported_chunks(spark, sf_dir):
    """Chunks exported as JSON lines and read back."""
    path = shared_path(spark, "export")
    writers.export_chunks(chunking.chunk_contents(_documents(spark, sf_dir), "window", {}), path)
    stored = spark.read.schema("content_id long, ordinal long, page_content string").json(path)
    return stored.select("content_id", "ordinal", "page_content")


@query(
    "S10",
    """SELECT vec_id AS chunk_id, label::VARCHAR AS storage_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::BIGINT AS dims FROM embeddings WHERE label = 3""",
)
def loaded_vectors(spark, sf_dir):
    """Vectors appended to the store by two jobs, and one index read back by its folder."""
    path = shared_path(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"),
        F.col("label").cast("string").alias("storage_id"), F.lit("given").alias("engine"),
    )
    for part in ("chunk_id % 2 = 0", "chunk_id % 2 <> 0", "chunk_id % 2 = 0"):  # the first job is run again
        writers.append_vectors(vectors.filter(part), path, job=part.replace(" ", ""))
    found = writers.load_vectors(spark, path, "3", "given")
    return found.select(
        "chunk_id", "storage_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("dims")
    )


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("content_id"), F.col("text").alias("body"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.col("source").alias("storage_id"),
    )


@query("S1, S2")
def listed_files(spark, sf_dir):
    files = readers.list_files(spark, sf_dir)
    return files.join(readers.file_fingerprints(spark, sf_dir), "url").select("file_name", "size", "hash", "is_dir")


@query(
    "S11",
    "SELECT source || '.pdf' AS title, '/' || source || '/' || doc_id AS path, doc_id::VARCHAR AS file_id, 'http://' || source || '/' || doc_id AS url, 9::BIGINT AS report_id FROM documents WHERE lang <> 'de'",
)
def sources_from_listing(spark, sf_dir):
    listing = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit(".pdf")).alias("file_name"), F.concat(F.lit("/"), "source", F.lit("/"), "doc_id").alias("path"),
        F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("http://"), "source", F.lit("/"), "doc_id").alias("url"),
        (F.col("lang") == "de").alias("is_dir"),
    )
    return writers.rows_from_listing(listing, 9)


@query(
    "S12, V2",
    knn_sql(5)
    + """SELECT query_id, 'question ' || query_id AS text, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS chunk_ids, 'flat' AS model
         FROM knn GROUP BY query_id""",
)
def retrieval_log_rows(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    corpus = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("storage_id"), "embedding")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("question "), "vec_id").alias("text"), "embedding")
    hits = search.nearest(corpus, queries, k=5)
    log = writers.log_retrieval(hits, queries, "flat", F.lit("2024-01-01"))
    return log.select("query_id", "text", F.array_join(F.transform("chunk_ids", lambda i: i.cast("string")), ",").alias("chunk_ids"), "model")


@query("C7, V1, V2, V4, V14, V15, T14, T15")
def contexts_for_questions(spark, sf_dir):
    """Documents to chunks to vectors to the context of every benchmark question."""
    contents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("content_id"), F.col("source").alias("storage_id"), F.col("text").alias("body"),
        F.create_map(F.lit("url"), F.concat(F.lit("http://"), "source", F.lit("/"), "doc_id")).alias("metadata"),
    )
    config = {"chunk_size": 300, "chunk_overlap": 30}
    chunks, vectors = flows.chunk_and_embed(contents, "recursive", config, "word-hash", embed.word_hash_model)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    as_chunks = questions.select(F.col("query_id").alias("chunk_id"), F.lit("q").alias("storage_id"), F.col("text").alias("page_content"))
    asked = embed.embed_chunks(as_chunks, "word-hash", embed.word_hash_model).withColumnRenamed("chunk_id", "query_id")
    found = flows.answer_contexts(questions, asked, chunks, vectors)
    return found.select("query_id", F.md5("context").alias("fingerprint"), F.length("context").alias("n_chars"))
