"""Sharding by a Feistel permutation: a reproducible shuffle whose shards and slots are computed, not looked up.

Rows get global numbers in the order of their ids. A keyed Feistel network permutes [0, rows): its two halves are residues
whose product is just above the number of rows, and a value that falls outside walks on along its cycle until it is inside.
Place p of the permutation is slot p div shards of shard p mod shards, so shard sizes differ by one row at most (law
``rows``) and slots have no gaps. ``place`` and ``row_number_at`` compute either direction for any row without the table.

Null texts have size 1. Rows with a null id come first; rows that agree in id and text are interchangeable, so the result
does not depend on how they were read. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, whole_text

SHARDS = 8
SEED = 20_240_229
ROUNDS = 6
# Increment and multipliers of the splitmix64 mixing function.
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LOCAL_BITS = 33  # monotonically_increasing_id: number of the partition above, of the row within it below


def sides(rows: int) -> tuple[int, int]:
    """Two factors, nearly equal, whose product holds all rows and exceeds them by less than one factor."""
    left = math.isqrt(rows - 1) + 1 if rows else 1
    return left, max(-(-rows // left), 1)


def mixed(values: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """64 mixed bits of each value, another function in every round and for every seed."""
    x = values.astype(np.uint64) + np.uint64((seed + (turn + 1) * STEP) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _walk(numbers: np.ndarray, rows: int, step) -> np.ndarray:
    """Apply a permutation of the larger range, again and again where the value is not a row."""
    out = step(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= rows)):
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def place(numbers: np.ndarray, rows: int, seed: int = SEED) -> np.ndarray:
    """Place of each row number in the shuffled order of ``rows`` rows."""
    a, b = map(np.uint64, sides(rows))

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x // b, x % b
        for turn in range(0, ROUNDS, 2):
            left = (left + mixed(right, turn, seed) % a) % a
            right = (right + mixed(left, turn + 1, seed) % b) % b
        return left * b + right

    return _walk(numbers, rows, step)


def row_number_at(places: np.ndarray, rows: int, seed: int = SEED) -> np.ndarray:
    """The row number that stands at each place: the rounds backwards."""
    a, b = map(np.uint64, sides(rows))

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x // b, x % b
        for turn in range(ROUNDS - 2, -1, -2):
            right = (right + b - mixed(left, turn + 1, seed) % b) % b
            left = (left + a - mixed(right, turn, seed) % a) % a
        return left * b + right

    return _walk(places, rows, step)


def row_numbers(rows: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """The rows with their place in an order, from 0, and how many they are.

    A range-partitioned sort is written once; the number of a row is the size of the ranges before its own, one small row
    each, plus its place within the range. Equal rows may lie in several ranges, so that no key makes a range large.
    """
    spread = rows.withColumn("_copy", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*order, "_copy").sortWithinPartitions(*order, "_copy").drop("_copy")
    kept = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", LOCAL_BITS)
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    spark, schema = rows.sparkSession, f"_part long, {out}_first long"
    first = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], schema)
    local = F.col("_at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    numbered = kept.withColumn("_part", part).join(F.broadcast(first), "_part")
    return numbered.withColumn(out, F.col(f"{out}_first") + local).drop("_part", "_at", f"{out}_first"), starts[-1]


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number of every row."""
    text = whole_text()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_mark"))
    numbered, total = row_numbers(slim, ["doc_id", "text_crc32", "text_mark", "size"], "row_number")

    @F.pandas_udf("long")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(place(numbers.to_numpy(), total, seed))

    at = numbered.withColumn("place", placed("row_number"))
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def _shard_sql() -> str:
    """The same rule in SQL, one round of the network a step; texts are unique by doc_id there."""
    whole = "18446744073709551616::UHUGEINT"
    first = f"((v::UHUGEINT + {SEED} + (turn + 1)::UHUGEINT * {STEP}::UHUGEINT) % {whole})::UBIGINT"
    second = f"((xor(m1, m1 >> 30))::UHUGEINT * {MIX_A}::UHUGEINT % {whole})::UBIGINT"
    third = f"((xor(m2, m2 >> 27))::UHUGEINT * {MIX_B}::UHUGEINT % {whole})::UBIGINT"
    stepped = "c >> 8"  # a byte's share of the checksum is the sum of its bits' shares
    for bit in range(8):
        share = 1 << bit
        for _ in range(8):
            share = share >> 1 ^ (share & 1) * 0xEDB88320
        stepped = f"xor({stepped}, ((xor(c, x) >> {bit}) & 1) * {share}::UBIGINT)"
    return f"""
WITH RECURSIVE total AS (
  SELECT n, a, greatest((n + a - 1) // a, 1) AS b
  FROM (SELECT n, CASE WHEN sqrt(n)::BIGINT * sqrt(n)::BIGINT >= n THEN sqrt(n)::BIGINT ELSE sqrt(n)::BIGINT + 1 END AS a FROM (SELECT count(*) AS n FROM documents))
), d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS body, row_number() OVER (ORDER BY doc_id) - 1 AS row_number FROM documents
), walk AS (
  SELECT row_number, row_number // b AS l, row_number % b AS r, 0 AS turn FROM d, total
  UNION ALL
  SELECT row_number, CASE WHEN turn % 2 = 0 THEN (l + (xor(m3, m3 >> 31) % a::UBIGINT)::BIGINT) % a ELSE l END,
    CASE WHEN turn % 2 = 1 THEN (r + (xor(m3, m3 >> 31) % b::UBIGINT)::BIGINT) % b ELSE r END, turn + 1
  FROM (SELECT *, {third} AS m3 FROM (SELECT *, {second} AS m2 FROM (SELECT *, {first} AS m1 FROM (
    SELECT row_number, l, r, CASE WHEN turn = {ROUNDS} THEN 0 ELSE turn END AS turn, CASE WHEN turn % 2 = 0 THEN r ELSE l END AS v
    FROM walk, total WHERE turn < {ROUNDS} OR l * b + r >= n)))), total
), placed AS (SELECT row_number, l * b + r AS place FROM walk, total WHERE turn = {ROUNDS} AND l * b + r < n)
SELECT doc_id, length(body) // 2 + 1 AS size,
  xor(list_reduce([4294967295::UBIGINT] || list_transform(regexp_extract_all(body, '..'), lambda p: ('0x' || p)::UBIGINT),
    lambda c, x: {stepped}), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  'rows' AS law, (place % {SHARDS})::INTEGER AS shard, place // {SHARDS} AS slot, NULL::INTEGER AS grown_shard, row_number
FROM d JOIN placed USING (row_number)"""


SHARD_SQL = _shard_sql()
