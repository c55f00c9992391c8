"""Exact nearest neighbours with pruning: cells around centres, cut into rings, grouped into regions of bounded size.

Every vector belongs to its nearest centre; a cell is cut into rings by distance from the centre, and a ring with very many
vectors into pieces by id, so no piece is large whatever the data look like. By the triangle inequality no vector of a ring is
nearer to a query than the gap between the ring and the query's own distance from that centre. The k-th distance that a query
finds in a bounded sample of the corpus rules out all pieces with a wider gap. Consecutive pieces form a region; a query goes,
once, to every region with an open piece. One task meets one region with one block of queries, slice by slice with one matrix
product, and skips pieces that the distances found so far rule out. Vectors travel once a region, not once a piece.

Centres only decide how much is skipped, never what is found: they are means of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

HITS = "query_id long, partition_key string, item_id long, cost double"
HITS_ARROW = pa.schema([("query_id", pa.int64()), ("partition_key", pa.string()), ("item_id", pa.int64()), ("cost", pa.float64())])
BLOCK_BYTES = 64 * 1024 * 1024
ROWS, COLUMNS = 2048, 512  # queries and vectors of one matrix product: 8 MB of costs
VISITS = 16_384  # visits of one Arrow batch
LEAST_REGIONS, BOUND_SAMPLE = 8, 4096
MOST_CENTRES, MOST_PIECES = 1024, 1 << 18
SAMPLE = 16_384
PIECE_ROWS = 16_384
BINS = 64
SLACK = 2e-6  # costs count to six decimals


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def squared_distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2.0 * q @ v.T, 0.0)


def half_up(costs: np.ndarray) -> np.ndarray:
    """Six decimals, halves upwards as SQL rounds: every later comparison uses this value."""
    return np.floor(costs * 1e6 + 0.5) / 1e6


def means_of(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Centres of a sample: evenly spaced rows of it, moved to the means of what is nearest to them."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        nearest = squared_distances(sample, centres).argmin(axis=1)
        size = np.bincount(nearest, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def sample_of(vectors: DataFrame, n: int) -> pa.Table:
    """About SAMPLE rows (item_id, payload) at most of a table of n vectors, chosen by a hash of the id."""
    share = F.pmod(F.xxhash64("item_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    rows = vectors.select(*[c for c in ("partition_key", "item_id", "payload") if c in vectors.columns])
    sample = rows.filter(share).orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).toArrow()
    return sample if len(sample) else rows.limit(1).toArrow()


@dataclass
class Pieces:
    """Where the pieces lie: one short row each."""

    name: np.ndarray
    key: np.ndarray  # number of the partition key
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    centres: np.ndarray
    region: np.ndarray  # ascending: consecutive pieces of bounded size together
    n_keys: int
    samples: dict[int, np.ndarray]  # some vectors of every key

    def gaps(self, queries: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """How near a vector of each piece can be to each query at the least, squared."""
        away = np.sqrt(squared_distances(queries, self.centres))[:, self.cell[some]]
        return np.maximum(np.maximum(away - self.high[some], self.low[some] - away) - 1e-9, 0.0) ** 2

    def first(self, gaps: np.ndarray, k: int) -> np.ndarray:
        """For one query the nearest pieces of every key, as many as hold k vectors."""
        order = np.lexsort((gaps, self.key))
        key, rows = self.key[order], self.rows[order]
        before = np.cumsum(rows) - rows
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        before -= np.repeat(before[start], np.diff(np.append(start, len(key))))
        return order[before < k]

    def bounds(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Upper bounds of the k-th cost of every query by key: what it finds among the sample."""
        bounds = np.full((len(queries), self.n_keys), np.inf)
        for key, vectors in self.samples.items():
            if len(vectors) >= k:
                bounds[:, key] = half_up(np.partition(squared_distances(queries, vectors), k - 1, axis=1)[:, k - 1])
        return bounds

    def spans(self, places: np.ndarray) -> list[tuple[int, int]]:
        """Cuts of a sorted column of pieces: whole pieces of one key up to COLUMNS rows, longer pieces in parts."""
        ends = np.append(np.flatnonzero(np.diff(places)) + 1, len(places)).tolist()
        spans, start, last = [], 0, 0
        for end in ends:
            if last > start and (end - start > COLUMNS or self.key[places[last]] != self.key[places[start]]):
                spans.append((start, last))
                start = last
            while end - start > COLUMNS:
                spans.append((start, start + COLUMNS))
                start += COLUMNS
            last = end
        return [*spans, (start, last)] if last > start else spans


class VectorCells:
    """A corpus of vectors (partition_key string, item_id long, payload array) in pieces, ready to be searched."""

    def __init__(self, corpus: DataFrame, block_bytes: int = BLOCK_BYTES):
        self.block_bytes = block_bytes
        key = F.concat(F.lit("="), "partition_key")  # a missing key is the empty one inside
        corpus = corpus.select(F.coalesce(key, F.lit("")).alias("partition_key"), "item_id", "payload").filter("payload IS NOT NULL")
        size = corpus.agg(F.count("*").alias("n"), F.max(F.size("payload")).alias("dims"), F.approx_count_distinct("partition_key").alias("keys")).first()
        self.n, keys = size["n"], max(size["keys"], 1)
        if not self.n:
            return
        n_centres = max(1, min(MOST_CENTRES, int((self.n / keys) ** 0.5), MOST_PIECES // keys))
        sampled = sample_of(corpus, self.n)
        sample = matrix(sampled.column("payload"))
        self.centres = means_of(sample, min(n_centres, len(sample)))
        self.region_rows = max(1, min(BLOCK_BYTES // (16 * max(size["dims"], 1)), -(-self.n // LEAST_REGIONS)))
        piece_rows = max(1, min(PIECE_ROWS, block_bytes // (16 * max(size["dims"], 1))), -(-self.n // MOST_PIECES))
        self._cut(corpus, piece_rows, sampled)

    def _cut(self, corpus: DataFrame, piece_rows: int, sampled: pa.Table) -> None:
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                costs = squared_distances(matrix(batch.column("payload")), centres)
                cell = costs.argmin(axis=1)
                away = np.sqrt(costs[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

        vector = corpus.schema["payload"].dataType.simpleString()
        placed = cut_lineage(corpus.mapInArrow(place, f"partition_key string, item_id long, payload {vector}, cell int, away double"))
        cell = ["partition_key", "cell"]
        radii = placed.groupBy(*cell).agg(F.max("away").alias("radius"))
        at = F.when(F.col("radius") > 0, F.least(F.floor(F.col("away") / F.col("radius") * BINS), F.lit(BINS - 1))).otherwise(0)
        binned = placed.join(radii, cell).withColumn("bin", at.cast("int")).drop("radius")
        counted = binned.groupBy(*cell, "bin").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
        before = F.sum("n").over(Window.partitionBy(*cell).orderBy("bin")) - F.col("n")  # at most BINS rows
        rings = counted.withColumn("ring", F.floor(before / piece_rows)).withColumn("parts", F.ceil(F.col("n") / piece_rows))
        rings = cut_lineage(rings)
        name = F.xxhash64(*cell, "ring", F.pmod(F.xxhash64("item_id"), F.col("parts")))
        ringed = binned.join(rings.select(*cell, "bin", "ring", "parts"), [*cell, "bin"])
        self.placed = cut_lineage(ringed.select(name.alias("piece"), "partition_key", "item_id", "payload"))
        edges = rings.groupBy(*cell, "ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("parts").alias("parts"), F.sum("n").alias("n"))
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        named = edges.withColumn("part", part).select(F.xxhash64(*cell, "ring", "part").alias("piece"), "partition_key", "cell", "low", "high", F.floor(F.col("n") / F.col("parts")).alias("rows"))
        listed = named.toArrow().to_pandas()  # one short row a piece
        # pieces of a key stand together, along the direction in which the centres differ most
        along = (centres @ np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0])[listed["cell"].to_numpy()]
        key, self.keys = pd.factorize(listed["partition_key"])
        order = np.lexsort((listed["low"], along, key))
        listed, key, self.keys = listed.iloc[order], key[order], self.keys.tolist()
        before = np.cumsum(listed["rows"].to_numpy()) - listed["rows"].to_numpy()
        name, cell, low, high, rows = (listed[c].to_numpy() for c in ("piece", "cell", "low", "high", "rows"))
        some = sampled.take(np.unique(np.linspace(0, len(sampled) - 1, BOUND_SAMPLE).astype(int)))
        numbers = {k: i for i, k in enumerate(self.keys)}
        own, vectors = np.array([numbers[k] for k in some.column("partition_key").to_pylist()]), matrix(some.column("payload"))
        samples = {int(k): vectors[own == k] for k in np.unique(own)}
        self.pieces = Pieces(name, key, cell, low, high, rows, centres, before // self.region_rows, len(self.keys), samples)

    def first_visits(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, payload, piece): the nearest pieces of every query."""
        pieces = self.pieces
        return self._visits(queries, lambda batch, gaps: [pieces.first(row, k) for row in gaps])

    def later_visits(self, queries: DataFrame, k: int) -> DataFrame:
        """The same for all other pieces that the found distances do not rule out.

        ``queries`` also holds ``bounds``: the k-th distance that a query has found, by partition key.
        """
        pieces, keys = self.pieces, self.keys

        def choose(batch: pa.RecordBatch, gaps: np.ndarray) -> list[np.ndarray]:
            chosen = []
            for row, bounds in zip(gaps, batch.column("bounds").to_pylist()):
                found = dict(bounds or [])
                bound = np.array([found.get(key, np.inf) for key in keys])[pieces.key]
                open_ = row <= bound + SLACK + 1e-9 * np.abs(bound)
                open_[pieces.first(row, k)] = False
                chosen.append(np.flatnonzero(open_))
            return chosen

        return self._visits(queries, choose)

    def near_visits(self, reach: float) -> DataFrame:
        """The corpus' own vectors at all pieces that may hold one within ``reach`` of them.

        Of two pieces only the one of the smaller name visits. Vectors that share a partition key other than the missing
        one are taken as known to be connected, so they do not visit each other.
        """
        pieces = self.pieces
        codes = {key: i for i, key in enumerate(self.keys)}

        def choose(batch: pa.RecordBatch, gaps: np.ndarray) -> list[np.ndarray]:
            own, keys = batch.column("own").to_numpy(), batch.column("own_key").to_pylist()
            open_ = (gaps <= reach * reach) & (pieces.name[None, :] >= own[:, None])
            known = np.array([codes[key] if key else -1 for key in keys])
            open_ &= pieces.key[None, :] != known[:, None]
            return [np.flatnonzero(row) for row in open_]

        return self._visits(self.placed.select(F.col("item_id").alias("query_id"), "payload", F.col("piece").alias("own"), F.col("partition_key").alias("own_key")), choose)

    def _visits(self, queries: DataFrame, choose) -> DataFrame:
        pieces = self.pieces
        step = max(1, 4_000_000 // max(len(pieces.name), 1))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    chosen = choose(part, pieces.gaps(matrix(part.column("payload"))))
                    rows = np.repeat(np.arange(part.num_rows), [len(c) for c in chosen])
                    names = pieces.name[np.concatenate(chosen).astype(np.int64)]
                    for first in range(0, len(rows), VISITS):
                        some = pa.array(rows[first : first + VISITS])
                        taken = [part.column(c).take(some) for c in ("query_id", "payload")]
                        yield pa.RecordBatch.from_arrays([*taken, pa.array(names[first : first + VISITS])], ["query_id", "payload", "piece"])

        vector = queries.schema["payload"].dataType.simpleString()
        return queries.mapInArrow(visit, f"query_id long, payload {vector}, piece long")

    def in_regions(self, queries: DataFrame, sent, k: int | None = None) -> DataFrame:
        """(query_id, payload, region, own, known, bounds) of every query at the regions that ``sent`` leaves open.

        ``sent`` says by query and piece, from the batch, the gaps and the bounds, which pieces are open. With ``k`` the
        bounds are the k-th costs that a query finds among the sample, by key: upper bounds of what it will find.
        """
        pieces, names = self.pieces, queries.columns
        step = max(1, 4_000_000 // max(len(pieces.name), BOUND_SAMPLE))
        starts = np.flatnonzero(np.append(True, np.diff(pieces.region) > 0))
        regions = pieces.region[starts]

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    q = matrix(part.column("payload"))
                    bounds = pieces.bounds(q, k) if k else np.zeros((len(q), 0))
                    rows, at = np.nonzero(np.logical_or.reduceat(sent(part, pieces.gaps(q), bounds), starts, axis=1))
                    own = part.column("own") if "own" in names else pa.nulls(part.num_rows, pa.int32())
                    known = part.column("known") if "known" in names else pa.nulls(part.num_rows, pa.int32())
                    # a visit carries its vector, so visits go out in slices
                    for first in range(0, len(rows), VISITS):
                        some = rows[first : first + VISITS]
                        limits = pa.ListArray.from_arrays((np.arange(len(some) + 1) * bounds.shape[1]).astype(np.int32), bounds[some].ravel())
                        taken = [column.take(pa.array(some)) for column in (part.column("query_id"), part.column("payload"), own, known)]
                        visited = pa.array(regions[at[first : first + VISITS]].astype(np.int32))
                        yield pa.RecordBatch.from_arrays([*taken, visited, limits], ["query_id", "payload", "own", "known", "region", "bounds"])

        vector = queries.schema["payload"].dataType.simpleString()
        return queries.mapInArrow(visit, f"query_id long, payload {vector}, own int, known int, region int, bounds array<double>")

    def regional(self) -> DataFrame:
        """(item_id, payload, place, key, region): the corpus with the number of its piece, of its key and of its region."""
        pieces = self.pieces
        order = np.argsort(pieces.name)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = order[np.searchsorted(pieces.name, batch.column("piece").to_numpy(), sorter=order)]
                found = [pa.array(values.astype(np.int32)) for values in (place, pieces.key[place], pieces.region[place])]
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("payload"), *found], ["item_id", "payload", "place", "key", "region"])

        vector = self.placed.schema["payload"].dataType.simpleString()
        return self.placed.mapInArrow(add, f"item_id long, payload {vector}, place int, key int, region int")

    def met(self, visits: DataFrame, queries: int, scan, schema: str) -> DataFrame:
        """``scan`` of every region and block of visiting queries; both are of bounded size."""
        blocks = max(1, -(-queries // self.region_rows))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        corpus = self.regional().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return visits.withColumn("block", block).groupBy("region", "block").cogroup(corpus.groupBy("region", "block")).applyInArrow(scan, schema)

    def scored(self, queries: DataFrame, count: int, k: int) -> DataFrame:
        """HITS rows: for every query the k nearest of each region and key that can be among its k nearest."""
        pieces, names, block_bytes = self.pieces, self.keys, self.block_bytes

        def sent(batch: pa.RecordBatch, gaps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            return gaps <= _widened(bounds)[:, pieces.key]

        def scan(asked: pa.Table, items: pa.Table) -> pa.Table:
            kept = []
            if asked.num_rows and items.num_rows:
                order = np.argsort(items.column("place").to_numpy(), kind="stable")
                place, ids, v = items.column("place").to_numpy()[order], items.column("item_id").to_numpy()[order], matrix(items.column("payload"))[order]
                query_ids, q = asked.column("query_id").to_numpy(), matrix(asked.column("payload"))
                limits = asked.column("bounds").combine_chunks().flatten().to_numpy().reshape(len(q), -1)
                spans, norms = pieces.spans(place), (v * v).sum(axis=1)
                inside = np.unique(place)
                rows = max(1, min(ROWS, block_bytes // (16 * q.shape[1]), 4_000_000 // len(inside)))
                for start in range(0, len(q), rows):
                    best = _Best(limits[start : start + rows].copy(), k)
                    part = 2.0 * q[start : start + rows]
                    lengths = (q[start : start + rows] ** 2).sum(axis=1)
                    gaps = pieces.gaps(q[start : start + rows], inside)
                    for first, end in spans:
                        of = np.searchsorted(inside, [place[first], place[end - 1]])
                        key = pieces.key[place[first]]
                        open_ = np.flatnonzero(gaps[:, of[0] : of[1] + 1].min(axis=1) <= best.reach(key))
                        if len(open_):
                            costs = lengths[open_, None] + norms[first:end] - part[open_] @ v[first:end].T
                            best.take(key, open_, ids[first:end], costs)
                    found = best.rows()
                    keys = pa.array(names, pa.string()).take(pa.array(found[1]))
                    kept.append(pa.Table.from_arrays([pa.array(query_ids[start + found[0]]), keys, pa.array(found[2]), pa.array(found[3])], schema=HITS_ARROW))
            return pa.concat_tables(kept) if kept else HITS_ARROW.empty_table()

        return self.met(self.in_regions(queries, sent, k), count, scan, HITS)


def _widened(bounds: np.ndarray) -> np.ndarray:
    return bounds + SLACK + 1e-9 * np.abs(bounds)


class _Best:
    """The k lowest costs of a few queries by key; ``limits`` (queries by keys) shrink as hits come in."""

    def __init__(self, limits: np.ndarray, k: int):
        self.limits, self.k = limits, k
        self.kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # row, key, id, cost
        self.new, self.size = [], 0

    def reach(self, key: int) -> np.ndarray:
        return _widened(self.limits[:, key])

    def take(self, key: int, rows: np.ndarray, ids: np.ndarray, costs: np.ndarray) -> None:
        low = costs <= self.reach(key)[rows, None]
        if np.count_nonzero(low) > 4 * self.k * len(rows) and costs.shape[1] > self.k:
            low &= costs <= np.partition(costs, self.k - 1, axis=1)[:, self.k - 1 : self.k] + SLACK
        at, column = np.nonzero(low)
        if len(at):
            cost = half_up(np.maximum(costs[at, column], 0.0))
            self.new.append([rows[at], np.full(len(at), key, np.int64), ids[column], cost])
            self.size += len(at)
            if self.size > max(4 * self.k * len(self.limits), 10_000):
                self._shrink()

    def _shrink(self) -> None:
        row, key, ids, cost = (np.concatenate(columns) for columns in zip(self.kept, *self.new))
        order = np.lexsort((ids, cost, key, row))
        row, key, ids, cost = row[order], key[order], ids[order], cost[order]
        group = row * self.limits.shape[1] + key
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
        rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
        full = rank == self.k - 1
        self.limits[row[full], key[full]] = np.minimum(self.limits[row[full], key[full]], cost[full])
        own = rank < self.k
        self.kept, self.new, self.size = [row[own], key[own], ids[own], cost[own]], [], 0

    def rows(self) -> list[np.ndarray]:
        self._shrink()
        return self.kept


def top_k(corpus: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, cells: VectorCells | None = None) -> DataFrame:
    """query_id, partition_key, item_id, cost, rank: the exact k nearest vectors of every query and key by squared distance.

    ``corpus``: partition_key, item_id, payload; ``queries``: query_id, payload. Rows without a vector find nothing and are
    not found. Only ``block_bytes`` of queries are compared at once.
    """
    spark = queries.sparkSession
    cells = cells or VectorCells(corpus, block_bytes)
    queries = queries.select("query_id", "payload").filter("payload IS NOT NULL")
    if not cells.n:
        return spark.createDataFrame([], f"{HITS}, rank int")
    every = cells.scored(queries, queries.count(), k)
    order = Window.partitionBy("query_id", "partition_key").orderBy("cost", "item_id")
    best = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.withColumn("partition_key", F.when(F.col("partition_key") != "", F.substring("partition_key", 2, 1 << 30)))
