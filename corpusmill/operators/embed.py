"""Embedding jobs. A model is a parameter; the default needs no files and gives the same vectors everywhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_question, strip, text_key

SENT_ROWS = 512
VECTORS = "chunk_id long, storage_id string, engine string, embedding array<float>"


def hashed_embedding(df: DataFrame, text: str = "text", dims: int = 256, out: str = "embedding") -> DataFrame:
    """TF-IDF over hashed words, unit length, as array<double>."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    made = Pipeline(stages=stages).fit(df).transform(df)
    return made.withColumn(out, vector_to_array("_unit")).drop("_words", "_tf", "_idf", "_unit")


def pending_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks still to embed: no vector yet, not in error, not blank."""
    wanted = chunks.filter((F.col("status") != "error") & (strip(F.col("page_content")) != ""))
    return wanted.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def word_hash_model(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in model: sums of fixed pseudo-random directions of the words."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts):
            found = [zlib.crc32(word.encode()) % dims for word in text.lower().split()]
            row[:] = np.bincount(np.array(found, dtype=np.int64), minlength=dims)
        return out

    return encode


def embed_chunks(
    pending: DataFrame, engine: str, model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 8
) -> DataFrame:
    """Unit vectors of (chunk_id, storage_id, page_content). ``model`` is called once per task, what it gives with ``batch`` texts at once."""

    def run(batches):
        encode = model()
        for part in batches:
            for first in range(0, part.num_rows, SENT_ROWS):
                ids, storages, texts = part.slice(first, SENT_ROWS).columns
                made = [encode(texts.slice(start, batch).to_pylist()) for start in range(0, len(texts), batch)]
                vectors = np.concatenate([np.asarray(m, dtype=np.float64) for m in made])
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0).astype(np.float32)
                ends = pa.array(np.arange(len(unit) + 1) * unit.shape[1], pa.int32())
                embedding = pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids, storages, pa.array([engine] * len(ids)), embedding], ["chunk_id", "storage_id", "engine", "embedding"]
                )

    wanted = pending.select("chunk_id", F.col("storage_id").cast("string").alias("storage_id"), "page_content")
    return wanted.mapInArrow(run, VECTORS)


def embed_once(texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embed every distinct cleaned text once and give each (item_id, text) its vector.

    ``embed`` turns (text_id, text) into rows that also hold ``embedding``.
    """
    cleaned = texts.withColumn("clean", clean_question(F.col("text"))).withColumn("text_id", text_key(F.col("clean")))
    distinct = cleaned.groupBy("text_id").agg(F.first("clean").alias("text"))
    vectors = embed(distinct).select("text_id", "embedding")
    return cleaned.select("item_id", "clean", "text_id").join(vectors, "text_id").drop("text_id")
