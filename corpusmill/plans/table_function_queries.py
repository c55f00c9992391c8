"""Plug-ins used through SQL over all documents."""

from pyspark.sql import functions as F

from corpusmill.operators import table_functions as tf
from corpusmill.plans.registry import query, table


class Sentences(tf.SplitterPlugin):
    """Pieces of so many sentences; a sentence ends with a dot and a space."""

    name = "sentences"
    config_schema = {"size": {"type": int, "label": "Sentences", "help_text": "in one piece", "required": True}}

    def split(self, metadata, text):
        sentences = text.split(". ")
        for start in range(0, len(sentences), self.config["size"]):
            yield ". ".join(sentences[start : start + self.config["size"]]), {"first": str(start), "of": str(len(sentences))}


class Runs(tf.GroupPlugin):
    """Turns of one role in a row, taken together."""

    schema = "conv_id long, first_turn long, role string, n_turns long, n_chars long"

    def __init__(self):
        self.now = None

    def row(self, row):
        if self.now and self.now[2] == row["role"]:
            self.now[3] += 1
            self.now[4] += len(row["text"] or "")
        else:
            yield from self.end()
            self.now = [row["conv_id"], row["turn"], row["role"], 1, len(row["text"] or "")]

    def end(self):
        return [tuple(self.now)] if self.now else []


@query(
    "C9, C1",
    """WITH s AS (SELECT doc_id, source, string_split(text, '. ') AS parts FROM documents),
         p AS (SELECT doc_id, source, parts, unnest(range((len(parts) + 4) // 5)) AS ordinal FROM s)
       SELECT doc_id, ordinal::INTEGER AS ordinal, array_to_string(parts[ordinal * 5 + 1 : ordinal * 5 + 5], '. ') AS page_content, source,
         (ordinal * 5)::VARCHAR AS first, len(parts)::VARCHAR AS n_sentences FROM p""",
)
def splitter_function_pieces(spark, sf_dir):
    tf.splitter_function(spark, "sentences", Sentences, {"size": 5})
    table(spark, sf_dir, "documents").createOrReplaceTempView("function_documents")
    pieces = spark.sql("SELECT doc_id, p.* FROM function_documents, LATERAL sentences(text, map('source', source)) AS p")
    meta = F.col("metadata")
    return pieces.select("doc_id", "ordinal", "page_content", meta["source"].alias("source"), meta["first"].alias("first"), meta["of"].alias("n_sentences"))


@query(
    "S6",
    """SELECT doc_id, m.method, m.priority, CASE WHEN m.method = 'page' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END AS text
       FROM documents JOIN (VALUES ('plain', 1, 0), ('page', 2, 1)) m(method, priority, kind) ON doc_id % 3 = kind WHERE regexp_matches(text, '^[^<&]+$')""",
)
def extractor_function_texts(spark, sf_dir):
    """Documents as files of three kinds; the third kind has no extractor."""
    tf.extractor_function(spark)
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("^[^<&]+$"))
    extension = F.element_at(F.array(F.lit("txt"), F.lit("html"), F.lit("bin")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs.select("doc_id", F.encode("text", "UTF-8").alias("content"), extension.alias("extension")).createOrReplaceTempView("function_files")
    return spark.sql("SELECT doc_id, x.method, x.priority, x.text FROM function_files, LATERAL extracted(content, extension) AS x")


@query(
    "W1, W2",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS run FROM conversations)
       SELECT conv_id, min(turn) AS first_turn, role, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM t GROUP BY conv_id, role, run""",
)
def group_function_runs(spark, sf_dir):
    tf.group_function(spark, "runs", Runs)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("function_turns")
    return spark.sql("SELECT * FROM runs(TABLE(function_turns) PARTITION BY conv_id ORDER BY turn)")
