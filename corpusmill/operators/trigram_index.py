"""Trigram search by postings: an inverted index in parts of bounded size, and exact top-k lists from it.

Chunks are dealt into parts. A part holds, for every trigram, the places of the chunks that have it, and the number of
trigrams of every chunk. A query reads its trigrams' postings of a part from the rarest on. When what is still unread could
not bring an unseen chunk above the k-th best so far, no more chunks are taken in; the ones that can still reach it are
looked up in the remaining postings. Work grows with the postings that are met, and no matrix is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.search import rerank
from corpusmill.session import cut_lineage, shared_path
from corpusmill.sources import buckets

PART_BYTES = 8 * 1024 * 1024
QUERY_BYTES = 64 * 1024 * 1024
SCHEMA = "part INT, gram BIGINT, places BINARY, sizes BINARY"
CHUNK_TABLE = -1  # the row of a part that lists its chunks stands under this number
CLOSE = 1e-6  # similarities count to six decimals
BITS = 21  # of a code point
BLOCK_CHARS = 1 << 18  # letters whose windows are held at once


def word_line(text: Column) -> Column:
    """Words in lower case, two spaces between them: what the trigrams of a text are read from."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  "))


def grams_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, trigram) of lines of words, by line; a trigram is a number of three code points.

    Lines are read in blocks: what is held for every letter is held for one block.
    """
    owner, gram = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    first = 0
    while first < len(lines):
        last, size = first, 0
        while last < len(lines) and (last == first or size + len(lines[last]) <= BLOCK_CHARS):
            size += len(lines[last])
            last += 1
        at, found = _grams_of_block(lines[first:last])
        owner.append(at + first)
        gram.append(found)
        first = last
    return np.concatenate(owner), np.concatenate(gram)


def _grams_of_block(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a block of lines.

    Every word has two spaces before and one behind it, so a window is no trigram if its last two places are spaces.
    """
    padded = [f"  {line} " for line in lines]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(lines)), [len(p) for p in padded])[:-2]
    kept = (points[1:-1] != 32) | (points[2:] != 32)
    gram, owner = ((points[:-2] << 2 * BITS) | (points[1:-1] << BITS) | points[2:])[kept], owner[kept]
    # numbered trigrams leave room for the line in one sortable number
    codes, names = pd.factorize(gram)
    keys = np.unique(owner * max(len(names), 1) + codes)
    return keys // max(len(names), 1), names[keys % max(len(names), 1)]


def _part_rows(chunks: pa.Table) -> pa.Table:
    """The postings of one part."""
    part, ids = chunks.column("part")[0].as_py(), chunks.column("chunk_id").to_numpy().astype(np.int64)
    owner, gram = grams_of(chunks.column("line").to_pylist())
    sizes = np.bincount(owner, minlength=len(ids)).astype(np.int32)
    order = np.argsort(gram, kind="stable")
    gram, place = gram[order], owner[order].astype(np.int32)
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(gram))
    grams = [CHUNK_TABLE, *gram[starts].tolist()]
    places = [ids.tobytes(), *(place[a:b].tobytes() for a, b in zip(starts, ends))]
    columns = [pa.array([part] * len(grams), pa.int32()), pa.array(grams, pa.int64()), pa.array(places, pa.binary()), pa.array([sizes.tobytes(), *[None] * len(starts)], pa.binary())]
    return pa.Table.from_arrays(columns, ["part", "gram", "places", "sizes"])


class Part:
    """Postings of one part in memory."""

    def __init__(self, rows: pa.Table):
        grams = rows.column("gram").to_numpy()
        order = np.argsort(grams)
        self.grams, places = grams[order], rows.column("places").take(pa.array(order)).to_pylist()
        listed = len(order) and self.grams[0] == CHUNK_TABLE
        self.ids = np.frombuffer(places[0], dtype=np.int64) if listed else np.zeros(0, dtype=np.int64)
        self.sizes = np.frombuffer(rows.column("sizes")[int(order[0])].as_py(), dtype=np.int32).astype(np.int64) if listed else np.zeros(0, dtype=np.int64)
        self.places = [np.frombuffer(p, dtype=np.int32) for p in places]
        self.counts = np.zeros(len(self.ids), dtype=np.int64)
        self.read = 0  # postings met so far

    def best(self, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the k chunks most similar to a set of trigrams, among those that share any."""
        at = np.searchsorted(self.grams, grams)
        there = at < len(self.grams)
        there[there] = self.grams[at[there]] == grams[there]
        lists = [self.places[i] for i in at[there]]
        lists.sort(key=len)
        n, counts, seen = len(grams), self.counts, [np.zeros(0, dtype=np.int32)]
        check, open_to_all = 8, True
        for done, places in enumerate(lists, 1):
            self.read += len(places)
            seen.append(places[counts[places] == 0])
            counts[places] += 1
            left = len(lists) - done
            if done == check and left:
                check *= 2
                met = np.concatenate(seen)
                seen = [met]
                floor = self._floor(met, n, k)
                if left < n * (floor - CLOSE):  # a chunk not seen yet shares what is left at most
                    open_to_all = False
                    break
        met = np.concatenate(seen)
        if not open_to_all:
            met = self._finished(met, lists[done:], n, k)
        similar = counts[met] / (n + self.sizes[met] - counts[met])
        counts[np.concatenate(seen)] = 0
        similar = np.floor(similar * 1e6 + 0.5) / 1e6
        order = np.lexsort((self.ids[met], -similar))[:k]
        return self.ids[met][order], similar[order]

    def _floor(self, met: np.ndarray, n: int, k: int) -> float:
        """What the k-th best chunk reaches at least."""
        if len(met) < k:
            return 0.0
        counts = self.counts[met]
        return float(np.partition(counts / (n + self.sizes[met] - counts), len(met) - k)[len(met) - k])

    def _finished(self, met: np.ndarray, lists: list[np.ndarray], n: int, k: int) -> np.ndarray:
        """Complete the counts of chunks that can still be among the k best, and return these."""
        for done, places in enumerate(lists):
            if done % 8 == 0:
                most = np.minimum(self.counts[met] + len(lists) - done, np.minimum(self.sizes[met], n))
                met = np.sort(met[most / (n + self.sizes[met] - most) >= self._floor(met, n, k) - CLOSE])
            self.read += min(len(met), len(places))
            if len(met) * 8 < len(places):  # look the few up in the many
                at = np.searchsorted(places, met)
                at[at == len(places)] = 0
                self.counts[met[places[at] == met]] += 1
            else:
                mine = np.zeros(len(self.ids), dtype=bool)
                mine[met] = True
                self.counts[places[mine[places]]] += 1
        return met


HITS = "query_id long, chunk_id long, similarity double, met long"
HITS_ARROW = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("similarity", pa.float64()), ("met", pa.int64())])


class TrigramIndex:
    """An inverted index in a folder, bucketed by part; it can be opened again by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = buckets.rows_of(spark, path)
        self.parts = buckets.manifest_of(spark, path)["buckets"]

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, part_bytes: int = PART_BYTES) -> TrigramIndex:
        """Index (chunk_id, page_content); null texts have no trigrams."""
        spark = chunks.sparkSession
        path = path or shared_path(spark, "trigrams")
        size = chunks.agg(F.sum(F.octet_length("page_content"))).first()[0] or 0
        # a small corpus still gives every core a part
        parts = max(-(-size // part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
        buckets.create(spark, path, SCHEMA, "part", "gram", parts)
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")
        dealt = chunks.select(part.alias("part"), F.col("chunk_id").cast("long").alias("chunk_id"), word_line(F.col("page_content")).alias("line"))
        buckets.append(dealt.groupBy("part").applyInArrow(_part_rows, SCHEMA), path)
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, chunk_id, similarity, met: of every part the k chunks most similar to a query that share a trigram with
        it, and how many postings the part read for it."""
        asked = cut_lineage(queries.select(F.col("query_id").cast("long").alias("query_id"), word_line(F.col("text")).alias("line")).mapInArrow(_query_grams, "query_id long, grams binary"))
        size = asked.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
        blocks = max(1, -(-size // QUERY_BYTES))
        wanted = asked.mapInArrow(_listed, "gram long").distinct()
        postings = self.rows.join(wanted, "gram", "left_semi").select(*self.rows.columns)
        every_part = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part")
        keys = ["part"]
        if blocks > 1:  # more queries than a task should hold
            keys.append("block")
            asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
            postings = postings.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = asked.select("*", every_part)

        def answer(postings: pa.Table, asked: pa.Table) -> pa.Table:
            part, found = Part(postings), []
            for query_id, grams in zip(asked.column("query_id").to_pylist(), asked.column("grams").to_pylist()):
                before = part.read
                ids, similar = part.best(np.frombuffer(grams, dtype=np.int64), k)
                found.append(pa.table([np.full(len(ids), query_id), ids, similar, np.full(len(ids), part.read - before)], schema=HITS_ARROW))
            return pa.concat_tables(found) if found else HITS_ARROW.empty_table()

        return postings.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(answer, HITS)


def _query_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, gram = grams_of(batch.column("line").to_pylist())
        cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        grams = pa.array([gram[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), grams], ["query_id", "grams"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct trigrams of a batch of queries, and the number of the chunk tables."""
    for batch in batches:
        grams = np.frombuffer(b"".join(batch.column("grams").to_pylist()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.unique(grams), CHUNK_TABLE))], ["gram"])


def trigram_search(chunks: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, index: TrigramIndex | None = None) -> DataFrame:
    """query_id, chunk_id, similarity, rank: the k chunks most similar to every query text by shared trigrams.

    Similarity is shared over united trigrams to six decimals, at least the threshold; equal ones go by id. Where fewer than
    k chunks share a trigram with a query, chunks of similarity 0 follow by id, as an ordered list of all chunks has them.
    """
    index = index or TrigramIndex.build(chunks)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    hits = index.search(queries, k).select("query_id", "chunk_id", "similarity")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("similarity") >= threshold))
    if threshold > 0:
        return hits
    hits = cut_lineage(hits)
    lowest = F.broadcast(chunks.select("chunk_id").orderBy("chunk_id").limit(k).agg(F.collect_list("chunk_id").alias("lowest")))  # k ids in one row
    short = queries.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    rest = short.select("query_id").join(lowest).select("query_id", F.explode("lowest").alias("chunk_id")).join(hits, ["query_id", "chunk_id"], "left_anti")
    both = hits.drop("rank").unionByName(rest.withColumn("similarity", F.lit(0.0)))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def reranked_matches(
    chunks: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], k: int = 10, threshold: float = 0.8, top_n: int = 5
) -> DataFrame:
    """query_id, chunk_id, similarity, rerank_score, rank: the trigram hits among ACTIVE chunks, reranked by their texts.

    ``score`` rates (query text, chunk text). The bound of the reranker is put on the similarity as it is, so hits at or
    above it go unless a query has no other ones.
    """
    active = chunks.filter(F.col("status") == "active").select("chunk_id", "page_content")
    hits = trigram_search(active, queries, k).drop("rank").withColumnRenamed("similarity", "distance")
    texts = hits.join(active, "chunk_id").join(queries.select("query_id", "text"), "query_id")
    best = rerank(texts, score(F.col("text"), F.col("page_content")), threshold=threshold, top_n=top_n)
    return best.select("query_id", "chunk_id", F.col("distance").alias("similarity"), "rerank_score", "rank")
