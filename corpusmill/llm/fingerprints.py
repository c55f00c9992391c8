"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the text, sketches of
parts merge by union, and the overlap of two sketches over the smaller one estimates containment even between very
unequal texts. Everything is DataFrame functions.

Words are runs of characters other than ASCII white space. A text of fewer than five words has its whole word sequence
as its one shingle; null, empty and blank texts have none. Two empty sketches are alike (1.0) if both texts are equal,
else 0.0; one empty sketch gives 0.0. Ties of doc_id are ordered by a hash of the text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACES, whole_text

WIDTH = 5
FRACTION = 0.25
HASH_BITS = 48  # of the 64-bit hash that are kept; 12 hexadecimal digits each
BLOCK_ROWS = 1_000
MOST_BLOCKS = 10_000


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """``df`` plus the sketch of a text column: its sorted distinct shingle hashes below ``fraction`` of the range."""
    # The words get a projection of their own, so they are split once.
    df = df.withColumn("_words", F.filter(F.split(F.col(text), SPACES), lambda w: w != ""))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - width, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(F.col("_words"), i + 1, F.lit(width))), 64 - HASH_BITS))
    below = int(fraction * 2**HASH_BITS)
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < below)))
    return df.withColumn(out, F.when(F.size("_words") > 0, kept).otherwise(F.array().cast("array<long>"))).drop("_words")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Overlap over the smaller sketch: the estimated containment of one text in the other."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.when(equal, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def digits(kept: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits a hash."""
    return F.concat_ws("", F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0"))))


def with_next(docs: DataFrame, carried: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, carried..., next_<carried>...): every row with the row of the next smaller doc_id; after the last, the first.

    ``docs`` holds doc_id and the carried columns. Rows are cut into blocks of neighbouring ids at quantiles of all ids,
    at most MOST_BLOCKS of them; each block also gets a copy of the first row of the block after it, so one window a
    block sees every neighbour and each row is shuffled once. No window holds more than a block.
    """
    order = [F.desc_nulls_last("doc_id"), F.xxhash64(*carried)]
    rows = docs.select("doc_id").where("doc_id IS NOT NULL")
    blocks = max(1, min(MOST_BLOCKS, -(-docs.count() // block_rows)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(blocks - 1, 0, -1)], 10 * blocks)).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    # blocks are numbered by descending id; an id at a cut belongs to the block above it; null ids come last
    above = lambda: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("doc_id")))
    block = lambda: F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(above()) if cuts else F.lit(0)
    firsts = {r["b"]: r["top"] for r in docs.select("doc_id", block().alias("b")).groupBy("b").agg(F.max("doc_id").alias("top")).collect()}
    if not firsts:
        return docs.select("doc_id", *carried, *[F.col(c).alias(f"next_{c}") for c in carried])
    filled = sorted(firsts)
    before = {b: filled[i - 1] if i else filled[-1] for i, b in enumerate(filled)}
    # A block's first row also goes, as a copy, to the end of the block before it: before[b], known for first ids only.
    is_first = F.col("doc_id").isin([i for i in firsts.values() if i is not None]) | (F.col("doc_id").isNull() if None in firsts.values() else F.lit(False))
    target = F.element_at(F.map_from_arrays(F.array(*map(F.lit, filled)), F.array(*[F.lit(before[b]) for b in filled])), F.col("block"))
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("copy"))
    copy = F.struct(target.alias("block"), F.lit(1).alias("copy"))
    places = F.when(is_first, F.array(own, copy)).otherwise(F.array(own))
    spread = docs.withColumn("block", block()).withColumn("place", F.explode(places)).select("doc_id", *carried, "place.block", "place.copy")
    window = Window.partitionBy("block").orderBy("copy", *order)
    following = [F.lead(c).over(window).alias(f"next_{c}") for c in carried]
    return spread.select("doc_id", *carried, "copy", *following).where("copy = 0").drop("copy")


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = with_next(with_sketch(rows, "text", "kept", fraction), ["text", "kept"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_kept", fraction)
    both = F.size(F.array_intersect("kept", "edited_kept"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("kept")).alias("fingerprint"),
        digits(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept"), F.col("text") == F.col("next_text")).alias("near_next"),
        F.coalesce(both / F.nullif(F.size("kept") + F.size("edited_kept") - both, F.lit(0)), F.lit(0.0)).alias("jaccard_edited"),
    )
