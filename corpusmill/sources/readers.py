"""Readers: file listings, URL and question lists, extracted texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import file_extension, strip


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: url, path, file_name, is_dir, last_modified, size, file_id. No content is read.

    Spark's file source passes over files without any byte.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        F.col("path").alias("url"),
        F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/*", "/").alias("path"),
        name.alias("file_name"),
        F.lit(False).alias("is_dir"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"),
        F.col("length").alias("size"),
        F.md5("path").alias("file_id"),
    )


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored Parquet table, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def fingerprint(c: Column, bits: int = 512) -> Column:
    """SHA-2 of text or bytes as lower-case hex."""
    return F.sha2(c, bits)


BLOCK = 1 << 20


def file_fingerprints(spark: SparkSession, root: str, block: int = BLOCK, algorithm: str = "sha512") -> DataFrame:
    """(url, hash) of all files below a folder. A task reads a file block by block; no file is ever a value of a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("url"))

    def run(batches):
        for batch in batches:
            hashes = []
            for url in batch.column("url").to_pylist():
                system, path = FileSystem.from_uri(re.sub(r"^file:/+", "/", url))
                seen = hashlib.new(algorithm)
                with system.open_input_stream(path) as stream:
                    while part := stream.read(block):
                        seen.update(part)
                hashes.append(seen.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(hashes, pa.string())], ["url", "hash"])

    return files.mapInArrow(run, "url string, hash string")


def url_list(raw: Column) -> Column:
    """URLs of a raw input: a JSON list of strings, else text split at line ends, commas and semicolons."""
    listed = F.when(strip(raw).rlike(r"^\[[\s\S]*\]$"), F.from_json(raw, "array<string>"))
    split = F.filter(F.transform(F.split(raw, r"[\r\n,;]+"), strip), lambda u: u != "")
    return F.filter(F.coalesce(listed, split), lambda u: u.startswith("http://") | u.startswith("https://"))


def question_lines(raw: Column) -> Column:
    """Non-blank trimmed lines of a text."""
    return F.filter(F.transform(F.split(raw, r"\r?\n"), strip), lambda q: q != "")


def csv_questions(raw: Column) -> Column:
    """First column of ';'-separated lines, quotes and blanks removed."""
    first = F.transform(question_lines(raw), lambda row: F.btrim(strip(F.split_part(row, F.lit(";"), F.lit(1))), F.lit('"')))
    return F.filter(first, lambda q: q != "")


def read_csv_questions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("sep", ";").option("header", False).csv(path)
    return rows.select(F.trim(rows.columns[0]).alias("question")).filter("question IS NOT NULL AND question <> ''")


# ---- texts of files ----

Extractor = Callable[[bytes], str]


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", errors="replace")


def page_text(content: bytes) -> str:
    from corpusmill.functions.html import Page

    return Page(plain_text(content)).text(0, " ")


# method name -> (priority, extensions, extractor); the first with a non-blank text wins
EXTRACTORS: dict[str, tuple[int, tuple[str, ...], Extractor]] = {
    "plain": (1, ("txt", "md", "csv"), plain_text),
    "page": (2, ("html", "htm"), page_text),
}


def register_extractor(name: str, priority: int, extensions: Iterable[str], extractor: Extractor) -> None:
    EXTRACTORS[name] = (priority, tuple(extensions), extractor)


def extract_texts(files: DataFrame) -> DataFrame:
    """Candidate texts of (path, content) by every extractor of the extension: path, method, priority, text."""
    chosen = dict(EXTRACTORS)
    known = files.withColumn("extension", file_extension(F.col("path"))).select("path", "extension", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for name, (priority, extensions, extractor) in chosen.items():
                    if row["extension"] in extensions:
                        try:
                            rows.append((row["path"], name, priority, extractor(row["content"])))
                        except Exception:  # a broken file has no text by this method
                            rows.append((row["path"], name, priority, None))
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "method", "priority", "text"]
            )

    return known.mapInArrow(run, "path string, method string, priority int, text string")


def best_text(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """First non-blank extraction of every document by priority; ``error`` where there is none."""
    usable = extractions.filter(strip(F.coalesce("text", F.lit(""))) != "")
    chosen = usable.groupBy("doc_id").agg(F.min_by(F.struct("method", "text"), F.struct("priority", "method")).alias("c"))
    joined = documents.join(chosen, "doc_id", "left")
    return joined.select(
        *documents.columns, "c.method", "c.text", F.when(F.col("c").isNull(), F.lit("no text recognised")).alias("error")
    )
