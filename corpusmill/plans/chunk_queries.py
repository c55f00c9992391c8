"""Chunking jobs over the whole documents and pages tables."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text
from corpusmill.functions.splitting import recursive_split
from corpusmill.operators import catalog as cat
from corpusmill.operators import chunking as ch
from corpusmill.operators import pages as pg
from corpusmill.plans.registry import query, table
from corpusmill.plans.standins import standin
from corpusmill.plans.text_queries import MARKED_SQL, count_sql, marked

WINDOWS_SQL = """windows AS (SELECT doc_id, i AS ordinal, substr(text, i * 800 + 1, 1000) AS page_content FROM documents,
  LATERAL (SELECT unnest(range(0, greatest(1, ceil((length(text) - 200) / 800.0))::BIGINT)) AS i))"""


def _contents(spark, sf_dir, name="documents"):
    empty = F.create_map().cast("map<string,string>")
    return table(spark, sf_dir, name).select(
        F.col("doc_id").alias("content_id"), F.col("text").alias("body"), empty.alias("metadata"), "lang", "source"
    )


def _summary(chunks, key="content_id"):
    """Per document: number, order, sizes and an order-aware fingerprint of the chunks.

    The fingerprint covers place, text and metadata of every chunk; equal chunks add up and do not cancel out."""
    chunk = F.xxhash64("ordinal", "page_content", F.array_sort(F.map_entries("metadata")))
    return chunks.groupBy(key).agg(
        F.count("*").alias("n_chunks"),
        F.sum("size_in_tokens").alias("n_tokens"),
        F.max("size_in_tokens").alias("largest"),
        F.xxhash64(F.sum(chunk.cast("decimal(20,0)"))).alias("fingerprint"),
    )


@query(
    "C10, T24, A4, W3, S7",
    f"""WITH {WINDOWS_SQL} SELECT {count_sql('page_content', text.TOKEN_PATTERN)}::BIGINT AS size_in_tokens, count(*) AS n_chunks
        FROM windows GROUP BY 1""",
)
def chunk_size_histogram(spark, sf_dir):
    chunks = ch.chunk_contents(_contents(spark, sf_dir), "window", {}).withColumn("status", F.lit("active"))
    return cat.size_histogram(chunks).select(F.col("size_in_tokens").cast("long").alias("size_in_tokens"), "n_chunks").orderBy(
        "size_in_tokens"
    )


@query("C10, W3, C7", f"WITH {WINDOWS_SQL} SELECT doc_id AS content_id, ordinal, page_content FROM windows")
def fixed_window_chunks(spark, sf_dir):
    chunks = ch.chunk_contents(_contents(spark, sf_dir), "window", {})
    return chunks.select("content_id", F.col("ordinal").cast("long").alias("ordinal"), "page_content")


@query(
    "C1",
    # without overlap the chunks hold every word once and in order
    r"""SELECT doc_id AS content_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS words FROM documents""",
)
def words_kept_by_recursive_split(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = recursive_split(documents, F.array("text"), 120, 0, -1)
    joined = F.array_join(F.transform("_cut", lambda p: p["text"]), " ")
    return split.select(F.col("doc_id").alias("content_id"), F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("words"))


SLICE_ROWS = 64
COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_kept", "n_foreign", "n_repeated")])


def shared_counts(own: pa.Array, got: pa.Array) -> pa.Array:
    """Of two lists of words a row: words of the first that the second has as often, words only the second has, and what it has too often."""
    done = [pa.array([], pa.struct([(f.name, pa.int64()) for f in COUNTS.fields]))]
    for start in range(0, len(own), SLICE_ROWS):
        sides = [c.slice(start, SLICE_ROWS) for c in (own, got)]
        rows = [np.repeat(np.arange(len(c)), pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)) for c in sides]
        coded = pa.concat_arrays([c.flatten() for c in sides]).dictionary_encode()
        width = max(len(coded.dictionary), 1)
        keys, at = np.unique(np.concatenate(rows) * width + coded.indices.to_numpy(), return_inverse=True)
        n, m = (np.bincount(part, minlength=len(keys)) for part in np.split(at, [len(rows[0])]))
        counts = (np.minimum(n, m), np.where(n == 0, m, 0), np.where(n > 0, np.maximum(m - n, 0), 0))
        totals = [np.bincount(keys // width, c, len(sides[0])).astype("int64") for c in counts]
        done.append(pa.StructArray.from_arrays([pa.array(t) for t in totals], COUNTS.names))
    return pa.concat_arrays(done)


@F.arrow_udf(COUNTS)
def _shared_counts(own: pa.Array, got: pa.Array) -> pa.Array:
    return shared_counts(own, got)


def _kept(chunks, contents, size, overlap):
    """Per document: words of its text that stand in its chunks as often as in the text, words that are not in the text at all,
    and whether chunks fit, are numbered without gaps and repeat no more than the overlap allows.

    A text and its chunks meet as texts in one row; their words are never rows."""
    no = F.lit(None).cast("int")
    own = contents.select("content_id", F.col("body").alias("own"), F.lit(None).cast("string").alias("got"), no.alias("size"), no.alias("at"))
    got = chunks.select("content_id", F.lit(None).cast("string"), "page_content", "size_in_tokens", "ordinal")
    met = own.union(got).groupBy("content_id").agg(
        F.collect_list("own").alias("own"), F.collect_list("got").alias("got"),
        F.max("size").alias("largest"), F.count("at").alias("chunks"), F.max("at").alias("last"),
    )
    words = lambda c: F.flatten(F.transform(c, lambda t: F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"))))
    counted = met.withColumn("_n", _shared_counts(words(F.col("own")), words(F.col("got"))))
    return counted.select(
        "content_id", "_n.n_kept", "_n.n_foreign",
        (F.col("largest") <= size).alias("fits"),
        (F.col("last") == F.col("chunks") - 1).alias("numbered"),
        F.when(F.col("chunks") > 0, F.col("_n.n_repeated") <= overlap * (F.col("chunks") - 1)).alias("repeats_fit"),
    )


def _kept_sql(body: str, rest: str) -> str:
    """What ``_kept`` gives for chunks that lose nothing: every word of the body."""
    return rf"""SELECT doc_id AS content_id, len(regexp_extract_all({body}, '[\p{{L}}\p{{N}}]+'))::BIGINT AS n_kept, 0::BIGINT AS n_foreign,
          true AS fits, true AS numbered, true AS repeats_fit FROM documents {rest}"""


@query("C1, C7", _kept_sql("text", r"WHERE regexp_matches(text, '\S')"))
def recursive_chunks(spark, sf_dir):
    contents = ch.usable(_contents(spark, sf_dir))
    chunks = ch.chunk_contents(contents, "recursive", {"chunk_size": 300, "chunk_overlap": 30}, report_id=1)
    return _kept(chunks, contents.select("content_id", "body"), 300, 30)


_HEADED = "concat('# ', source, '\n', replace(text, '\n', '\n## '))"


@query(
    "C2",
    r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        t AS (SELECT doc_id, source, pos, regexp_replace(line, '^[ \t]+|[ \t]+$', '', 'g') AS line FROM l),
        g AS (SELECT *, CASE WHEN pos > 1 AND line = lag(line) OVER w AND pos > 2 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section FROM g)
        SELECT doc_id, section, string_agg(CASE WHEN pos = 1 THEN '# ' || source || chr(10) || line ELSE '## ' || line END, '  ' || chr(10) ORDER BY pos) AS body,
          CASE WHEN min(pos) = 1 THEN source ELSE source || ' > ' || any_value(line) END AS trail
        FROM s GROUP BY doc_id, section, source""",
)
def markdown_sections(spark, sf_dir):
    sections = ch.header_sections(F.expr(_HEADED), [1, 2])
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sections).alias("at", "s"))
    trail = F.array_join(F.transform("s.path", lambda p: p["name"]), " > ")
    return split.select("doc_id", (F.col("at") + 1).cast("long").alias("section"), F.col("s.text").alias("body"), trail.alias("trail"))


@query("C2, C3, C4, T9, T10, T12, T13, P5, S5")
def page_chunks(spark, sf_dir):
    contents = pg.extract_pages(table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("content_id"), F.col("content").alias("body"),
        F.create_map(F.lit("url"), F.col("url")).alias("metadata"),
        "title", "tags", "images", "documents", "external_links", "internal_links",
    )
    config = {"chunk_size": 200, "chunk_overlap": 20, "min_tail": 30, "header_levels": [1, 2]} | {
        k: k for k in ("title", "tags", "images", "documents", "external_links", "internal_links")
    }
    return _summary(ch.chunk_contents(ch.usable(contents), "page", config))


def _legal(spark, sf_dir, **changes):
    config = {"min_chunk_size": 150, "max_chunk_size": 400, "chunk_overlap": 30, "drop_below": 20, "letters": "[A-Za-zÀ-ÿ]"} | changes
    contents = _contents(spark, sf_dir).withColumn("text", F.col("body")).withColumnRenamed("content_id", "doc_id")
    contents = contents.withColumn("body", marked()).withColumnRenamed("doc_id", "content_id")
    return ch.chunk_contents(contents, "legal", config), contents.select("content_id", "body")


@query(
    "T26, T27",
    "SELECT doc_id AS content_id, true AS numbered, 0::BIGINT AS n_misjudged FROM documents",
)
def legal_chunks(spark, sf_dir):
    chunks, contents = _legal(spark, sf_dir)
    # a chunk is of high quality by its letters and its left-over mark-up, counted here once more from its text
    body = F.col("page_content")
    share = 100 * F.length(F.array_join(F.regexp_extract_all(body, F.lit("([A-Za-zÀ-ÿ]+)")), "")) / F.length(body)
    marks = F.regexp_count(body, F.lit(r"#{1,6}|\*\*|\(\)|\[\]"))
    wrong = ((share >= 70) & (marks <= 2)) != (F.col("metadata")["high_quality"] == "true")
    judged = chunks.groupBy("content_id").agg(
        (F.max("ordinal") == F.count("*") - 1).alias("numbered"), F.count_if(wrong).cast("long").alias("n_misjudged")
    )
    # a document whose chunks are all below the bound has none
    return contents.select("content_id").join(judged, "content_id", "left").fillna(True, ["numbered"]).fillna(0)


@query("C5, C6", _kept_sql(MARKED_SQL, r"WHERE regexp_matches(text, '\S')"))
def whole_legal_chunks(spark, sf_dir):
    """With no bound on small chunks every word of a document has to be found again."""
    chunks, contents = _legal(spark, sf_dir, drop_below=0)
    return _kept(chunks, contents.filter(r"body rlike '\\S'"), 400, 30)


_LETTERS = "[A-Za-zÀ-ÿ]"
_ARTIFACTS = r"#{1,6}|\*\*|\(\)|\[\]"


@query(
    "T26",
    f"""WITH m AS (SELECT doc_id, length(text) AS c, {count_sql('text', text.TOKEN_PATTERN)} AS n, {count_sql('text', _LETTERS)} AS l,
          {count_sql('text', _ARTIFACTS)} AS a FROM documents)
        SELECT doc_id, c::BIGINT AS n_chars, n::BIGINT AS n_tokens, round(c::DOUBLE / n, 6) AS ratio, n BETWEEN 100 AND 600 AS in_range,
          c::DOUBLE / n BETWEEN 1.8 AND 4.0 AS ratio_ok, round(l::DOUBLE / c * 100, 6) AS share, a::BIGINT AS artifacts,
          l::DOUBLE / c * 100 >= 70 AND a <= 2 AS high_quality FROM m""",
)
def chunk_quality_metrics(spark, sf_dir):
    chunk = F.struct(F.col("text"), text.token_count(F.col("text")).alias("n_tokens"))
    q = table(spark, sf_dir, "documents").select("doc_id", ch.with_quality(chunk, 100, 600, _LETTERS).alias("q"))
    return q.select(
        "doc_id",
        F.col("q.n_chars").cast("long").alias("n_chars"),
        F.col("q.n_tokens").cast("long").alias("n_tokens"),
        F.round("q.char_token_ratio", 6).alias("ratio"),
        F.col("q.in_target_range").alias("in_range"),
        F.col("q.ratio_in_target").alias("ratio_ok"),
        F.round("q.script_share", 6).alias("share"),
        F.col("q.n_artifacts").cast("long").alias("artifacts"),
        F.col("q.high_quality"),
    )


@query(
    "C8",
    """SELECT doc_id AS source_id, CASE WHEN lang = 'de' THEN source || CASE WHEN n_chars > 1000 THEN ' about ' || source ELSE '' END
         || ' [Ссылка на файл]' || 'http://files/' || doc_id ELSE text END AS body
       FROM documents WHERE lang = 'de' OR lang <> 'es'""",
)
def document_bodies_to_chunk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("source_id"),
        F.col("source").alias("title"),
        F.when(F.col("n_chars") > 1000, F.concat(F.lit("about "), "source")).otherwise("").alias("description"),
        F.concat(F.lit("http://files/"), F.col("doc_id")).alias("file_url"),
        F.when(F.col("lang") == "de", "f").otherwise("t").alias("output_format"),
    )
    cleaned = table(spark, sf_dir, "documents").filter("lang <> 'es'").select(
        F.col("doc_id").alias("source_id"), F.col("text").alias("body")
    )
    return ch.document_bodies(docs, cleaned).select("source_id", "body")


@query(
    "C9, S8, P1, P4, P5",
    _kept_sql(
        r"regexp_replace(text, '\s*#{1,6}\s*', ' ', 'g')",
        "WHERE length(text) >= 200 AND (text ILIKE '%the%' OR 'http://' || source || '.example.com/' || doc_id ILIKE '%the%')",
    ),
)
def filtered_export_chunks(spark, sf_dir):
    texts = standin(spark, sf_dir, "texts")
    chosen = cat.with_body_length(cat.matching(texts, "the", ["body", "url"]), texts, 200, 10**9)
    newest = cat.latest_child(chosen.withColumn("created_at", F.col("n_chars")), "source_id", ["created_at"])
    contents = newest.select(
        F.col("source_id").alias("content_id"), "body", F.create_map(F.lit("url"), F.col("url")).alias("metadata"),
        F.col("storage_id").alias("title"), F.array("lang", "storage_id").alias("tags"),
    )
    config = {"chunk_size": 750, "chunk_overlap": 50, "header_levels": [1], "title": "title", "tags": "tags"}
    chunks = ch.chunk_contents(contents, "page", config)
    bare = F.regexp_replace("body", r"\s*#{1,6}\s*", " ").alias("body")  # heading signs are taken out of a page's chunks
    headless = chunks.withColumn("page_content", F.regexp_replace("page_content", r"^(Категории: [^.]*\. )?Заголовок: [^.]*\. ", ""))
    return _kept(headless, contents.select("content_id", bare), 750, 50)
