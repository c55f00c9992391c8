"""Quality reports and language of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import junk_ratio, letter_words
from corpusmill.session import cut_lineage

EMPTY = "Текст пуст после очистки"


WORDS = T.ArrayType(T.StructType([
    T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType())),
]))
WORDS_ARROW = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64()), ("places", pa.list_(pa.int32()))]))
SLICE_ROWS = 64
# so many words are met in the tasks, without moving the texts' words; all others by a join
FREQUENT_WORDS = 100_000


def counted(words: pa.Array, places: pa.Array) -> pa.Array:
    """The distinct words of every list with their number and places: the most frequent first, then the first to come."""
    done = [pa.array([], WORDS_ARROW)]
    for start in range(0, len(words), SLICE_ROWS):
        w, at = words.slice(start, SLICE_ROWS), places.slice(start, SLICE_ROWS).flatten().to_numpy()
        row = np.repeat(np.arange(len(w)), pc.list_value_length(w).fill_null(0).to_numpy(zero_copy_only=False))
        coded = w.flatten().dictionary_encode()
        key = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        order = np.lexsort((at, key))
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        n = np.diff(first, append=len(order))
        rank = np.lexsort((at[order][first], -n, row[order][first]))
        each = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(at[order], pa.int32()))
        found = pa.StructArray.from_arrays(
            [coded.dictionary.take(coded.indices.take(pa.array(order[first][rank]))), pa.array(n[rank], pa.int64()), each.take(pa.array(rank))],
            ["word", "n", "places"],
        )
        ends = np.cumsum(np.bincount(row[order][first], minlength=len(w)))
        done.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found).cast(WORDS_ARROW))
    return pa.concat_arrays(done)


@F.arrow_udf(WORDS)
def _counted(words: pa.Array, places: pa.Array) -> pa.Array:
    return counted(words, places)


def item_texts(texts: DataFrame) -> DataFrame:
    """(item_id, _w): the cleaned lower-case words of every text of an item. An item in several rows is one."""
    items = texts.filter("text IS NOT NULL").groupBy("item_id").agg(F.collect_list("text").alias("_t"))
    return items.select("item_id", F.transform("_t", lambda t: letter_words(F.lower(t))).alias("_w"))


def item_words(texts: DataFrame) -> DataFrame:
    """(item_id, words): the words of every item, counted in its row."""
    numbers = F.transform("_w", lambda w: F.transform(w, lambda _, i: i))
    return item_texts(texts).withColumn("words", _counted(F.flatten("_w"), F.flatten(numbers))).select("item_id", "words")


def word_counts(items: DataFrame) -> DataFrame:
    """(item_id, word, n, places) of ``item_words``."""
    return items.select("item_id", F.explode_outer("words").alias("w")).filter("w IS NOT NULL").select("item_id", "w.word", "w.n", "w.places")


def lexicon(texts: DataFrame, min_items: int = 2) -> DataFrame:
    """(word, items): words that stand in at least ``min_items`` items, a dictionary taken from the corpus itself."""
    words = item_texts(texts).select(F.explode_outer(F.array_distinct(F.flatten("_w"))).alias("word")).filter("word IS NOT NULL")
    return words.groupBy("word").agg(F.count("*").alias("items")).filter(F.col("items") >= min_items)


def quality_report(texts: DataFrame, valid_words: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Sizes, junk ratio, valid and invalid words and the most frequent words of (item_id, text).

    A text without words has only ``error``. ``valid_words`` (word) defaults to the corpus lexicon.
    """
    items = item_words(texts)
    counts = word_counts(items)
    known = lexicon(texts)
    if valid_words is not None:
        known = lexicon(texts, 1).join(valid_words.select("word"), "word", "left_semi")
    known = cut_lineage(known)
    # most words are frequent ones: they are left out in the tasks, only the rest moves to be looked up
    usual = known.orderBy(F.desc("items"), "word").limit(FREQUENT_WORDS).select("word")
    unknown = counts.join(F.broadcast(usual), "word", "left_anti").join(known.select("word"), "word", "left_anti")
    # every time an invalid word stands there counts, in the order of the text
    placed = F.transform("places", lambda at: F.struct(at.alias("at"), F.col("word").alias("word")))
    wrong = unknown.groupBy("item_id").agg(
        F.sum("n").alias("_wrong"),
        F.transform(F.array_sort(F.flatten(F.collect_list(placed))), lambda w: w["word"]).alias("_invalid"),
    )
    none = F.array().cast("array<string>")
    words = items.filter(F.size("words") > 0).select(
        "item_id",
        F.aggregate("words", F.lit(0).cast("long"), lambda total, w: total + w["n"]).alias("total_words"),
        F.transform(F.slice("words", 1, top), lambda w, i: F.struct((i + 1).alias("_r"), w["word"].alias("word"), w["n"].alias("n"))).alias("frequent"),
    )
    measured = texts.select("item_id", F.length("text").alias("total_chars"), junk_ratio(F.lower("text")).alias("junk"))
    joined = measured.join(words.join(wrong, "item_id", "left"), "item_id", "left")
    invalid_words = F.when(F.col("total_words").isNotNull(), F.coalesce("_wrong", F.lit(0).cast("long")))
    joined = joined.withColumn("invalid_words", invalid_words).withColumn("valid_words", F.col("total_words") - F.col("invalid_words"))
    return joined.select(
        "item_id",
        F.when(F.col("total_words").isNull(), F.lit(EMPTY)).alias("error"),
        "total_chars",
        "junk",
        "total_words",
        "valid_words",
        "invalid_words",
        (F.col("valid_words") / F.col("total_words")).alias("valid_ratio"),
        F.when(F.col("total_words").isNotNull(), F.coalesce("_invalid", none)).alias("invalid"),
        "frequent",
    )


def language_profiles(labelled: DataFrame, top: int | None = None) -> DataFrame:
    """(lang, word, weight): the words of every language, the most frequent weighing most; ``top`` takes only so many.

    A word weighs as much as its share of the language's words, so a long tail of rare words decides nothing.
    """
    words = F.explode_outer(letter_words(F.lower("text"))).alias("word")
    counted = labelled.select("lang", "text").select("lang", words).filter("word IS NOT NULL").groupBy("lang", "word").agg(F.count("*").alias("n"))
    weighed = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    if top:
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        counted = counted.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
    return counted.join(weighed, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("weight"))


def detect_language(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(item_id, detected): the language whose profile weighs most in the text, NULL when none occurs."""
    counts = word_counts(item_words(texts)).drop("places")
    weighed = cut_lineage(profiles.groupBy("word").agg(F.collect_list(F.struct("lang", "weight")).alias("_p"), F.sum("weight").alias("_w")))
    # most words are frequent ones: they meet their weights in the tasks, only the rest moves to be joined
    usual = weighed.orderBy(F.desc("_w"), "word").limit(FREQUENT_WORDS)
    rare = counts.join(F.broadcast(usual.select("word")), "word", "left_anti")
    each = lambda c: c.select("item_id", "n", F.explode("_p").alias("p")).groupBy("item_id", "p.lang").agg(F.sum(F.col("n") * F.col("p.weight")).alias("_s"))
    parts = each(counts.join(F.broadcast(usual), "word")).unionByName(each(rare.join(weighed, "word")))
    # sums to nine decimals, so that the order of the rows never decides
    scores = parts.groupBy("item_id", "lang").agg(F.round(F.sum("_s"), 9).alias("score"))
    best = scores.groupBy("item_id").agg(F.min_by("lang", F.struct(-F.col("score"), F.col("lang"))).alias("detected"))
    return texts.select("item_id").join(best, "item_id", "left")
