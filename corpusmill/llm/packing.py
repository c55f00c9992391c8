"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest length. Pieces are dealt by hash into shards of a bounded number of
words, and each shard is packed by itself: a piece goes into the open bin that it fills best; where none has room, a bin
of the length with the least cost for each word it can hold is opened; at the end each bin shrinks to the shortest
permitted length that holds its contents.

Null and empty texts, and texts of white space, give one row with n_words 0 and no bin, so no document is lost.
Repeated rows are packed as documents of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, whole_text, word_count

LENGTHS = (256, 512, 1024, 2048, 4096)
OUT = "doc_id long, piece int, first_word long, n_words long, bin_id long, capacity int, bin_words long"


def sequence_cost(length: int) -> float:
    """What a sequence costs: a fixed part, its words, and attention that grows with the square."""
    return 64 + length + length * length / 16384


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int]]:
    """Bin of each piece, and the length of each bin. Sizes are positive and at most the longest length."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = sum(sizes)
    bin_of, room, size = [0] * len(sizes), [], []
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in order:
        need = sizes[i]
        at = bisect_left(open_bins, (need, -1))
        if at < len(open_bins):
            free, b = open_bins.pop(at)
        else:
            # all that is still to be packed could go into it, at most as much as it holds
            length = min((c for c in lengths if c >= need), key=lambda c: (sequence_cost(c) / min(c, left), c))
            free, b = length, len(size)
            room.append(length)
            size.append(length)
        bin_of[i] = b
        room[b] = free - need
        if room[b]:
            insort(open_bins, (room[b], b))
        left -= need
    return bin_of, [min(c for c in lengths if c >= full - free) for full, free in zip(size, room)]


def best_fit(docs: DataFrame, lengths: Sequence[int] = LENGTHS, shard_words: int = 200_000) -> DataFrame:
    """One row a piece: doc_id, piece, first_word, n_words, bin_id, capacity, bin_words.

    Only ids and word counts are shuffled. ``shard_words`` bounds what one call packs, whatever the input; a bin_id is
    the shard's number times 2**32 plus the bin's.
    """
    longest = max(lengths)
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(whole_text()).alias("words")), "pack-sizes")
    words = sized.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    # repeated rows of one id share its hash, so their place in the stored table takes part too
    rows = sized.withColumn("place", F.monotonically_increasing_id())
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / longest).cast("int") - 1, F.lit(0)))
    pieces = rows.select("doc_id", "words", "place", F.explode(steps).alias("piece"))
    first = F.col("piece").cast("long") * longest
    pieces = pieces.select("doc_id", "piece", first.alias("first_word"), F.least(F.lit(longest), F.col("words") - first).alias("n_words"), F.pmod(F.xxhash64("doc_id", "piece", "place"), F.lit(shards)).alias("shard"))

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bin_of, capacity = pack(shard["n_words"].tolist(), lengths)
        bins = np.array(bin_of, dtype=np.int64)
        full = np.bincount(bins, shard["n_words"], len(capacity)).astype(np.int64)
        found = {"bin_id": shard["shard"].to_numpy() * 2**32 + bins, "capacity": np.array(capacity, dtype=np.int32)[bins], "bin_words": full[bins]}
        return shard.drop(columns="shard").assign(**found)

    filled = pieces.where("n_words > 0").groupBy("shard").applyInPandas(packed, OUT)
    empty = pieces.where("n_words <= 0").select("doc_id", "piece", "first_word", "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("long").alias("bin_words"))
    return filled.unionByName(empty)
