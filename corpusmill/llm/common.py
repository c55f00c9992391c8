"""What the operators of this subpackage share: stored tables, column names, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import ensure_checkpoint_dir

# Fixed value: the white space that ends a word, in the SQL and Java notation of character classes.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
# rows that reach the driver at most to place a cut among counts or hashes
BINS = 1 << 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared folder: later reads do not depend on the executors that made them."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words: padded at both ends, a text splits into its words between two empty strings."""
    return (F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), SPACES)) - 2).cast("long")


def crc_remainder(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts: the folds of the learned operators."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, max_rows: int) -> DataFrame:
    """(id, text, y) of about ``max_rows`` labelled rows at most, outside the held-out fold, chosen by a hash of the id.

    The bound makes the labels small enough to ship to every task (16 bytes a row), so no text is shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    texts = docs.select(F.col("doc_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")


def most_frequent(counted: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most ``most`` of them: whole levels of counts (16 an octave), and what room is
    left goes to the next level by exact count, at last by a hash of the row.

    ``counted`` must be stored: it is read up to four times. One row a level or bin, at most BINS, reaches the driver, and
    no sort is needed.
    """
    rest, chosen, room = counted.where(F.col(n) > 0), F.lit(False), most
    inside = F.col(n) > 0
    keys = [F.floor(F.log2(n) * 16), None, F.pmod(F.xxhash64(*counted.columns), F.lit(BINS))]
    for key in keys:
        if key is None:  # counts in this level, about 4% apart at most, in steps
            least, largest = rest.agg(F.min(n), F.max(n)).first()
            key = F.floor((F.col(n) - least) / ((largest - least) // BINS + 1))
        sizes = {r["key"]: r["rows"] for r in rest.groupBy(key.alias("key")).agg(F.count("*").alias("rows")).collect()}
        over, cut = None, max(sizes, default=0) + 1
        for at in sorted(sizes, reverse=True):
            if sizes[at] > room:
                over = at
                break
            room, cut = room - sizes[at], at
        chosen = chosen | (inside & (key >= cut))
        if over is None or not room:
            break
        rest, inside = rest.where(key == over), inside & (key == over)
    return counted.where(chosen)
