import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.operators import trigram_index
from corpusmill.operators.trigram_index import BITS, Part, TrigramIndex, _part_rows, grams_of, trigram_search, word_line
from corpusmill.sources import buckets


def trigrams(text):
    words = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def similarity(a, b):
    return int(len(a & b) / len(a | b) * 1e6 + 0.5) / 1e6 if a | b else 0.0


def ranked(query, chunks, k, threshold=0.0):
    mine = trigrams(query)
    order = sorted((-similarity(mine, trigrams(t)), i) for i, t in chunks)
    return [(i, -s) for s, i in order[:k] if -s >= threshold]


def spelled(gram):
    return "".join(chr(gram >> BITS * i & (1 << BITS) - 1) for i in (2, 1, 0))


@given(st.lists(st.text("ab é中😀.-1 ", max_size=20), max_size=8))
@settings(max_examples=200, deadline=None)
def test_windows_are_the_trigrams_of_words(texts):
    lines = ["  ".join("".join(c if c.isalnum() else " " for c in t).split()) for t in texts]
    owner, gram = grams_of(lines)
    for i, line in enumerate(lines):
        assert {spelled(int(g)) for g in gram[owner == i]} == trigrams(line)
        assert len(gram[owner == i]) == len(trigrams(line))


def test_letters_of_many_lines_are_held_by_blocks():
    r = random.Random(3)
    lines = ["  ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(50)) for _ in range(400)) for _ in range(800)]
    tracemalloc.start()
    try:
        owner, gram = grams_of(lines)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.all(np.diff(owner) >= 0) and owner[-1] == len(lines) - 1
    assert {spelled(int(g)) for g in gram[owner == 700]} == trigrams(lines[700])
    assert peak < 8 * sum(map(len, lines))  # one number of 8 bytes a letter, where all letters at once need several


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    words = ["".join(r.choice("abcdef") for _ in range(r.randrange(1, 7))) for _ in range(300)]
    chunks = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(400)]
    chunks += [(1000 + i, chunks[7][1]) for i in range(150)]  # a group of copies
    chunks += [(2000, None), (2001, ""), (2002, "?! ..."), (2003, "Naïve 😀 Ünïcode")]
    queries = [(i, chunks[i * 9][1]) for i in range(30)] + [(90, "naïve"), (91, None), (92, "zzzzzz"), (93, "a")]
    return chunks, queries


@pytest.mark.parametrize("limits", [{}, {"PART_BYTES": 500, "QUERY_BYTES": 900}])
def test_lists_match_brute_force(spark, texts, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(trigram_index, name, value)
    chunks, queries = texts
    table = spark.createDataFrame(chunks, "chunk_id long, page_content string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    index = TrigramIndex.build(table, part_bytes=limits.get("PART_BYTES", 8 * 2**20))
    for threshold in (0.0, 0.3):
        got = trigram_search(table, asked, k=6, threshold=threshold, index=index).orderBy("query_id", "rank").collect()
        for query_id, text in queries:
            mine = [(r["chunk_id"], r["similarity"]) for r in got if r["query_id"] == query_id]
            assert mine == ranked(text, chunks, 6, threshold), query_id


def test_an_index_is_opened_again_with_its_own_parts(spark, texts):
    chunks, queries = texts
    table, asked = spark.createDataFrame(chunks, "chunk_id long, page_content string"), spark.createDataFrame(queries, "query_id long, text string")
    made = TrigramIndex.build(table)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = TrigramIndex(spark, made.path)
        assert again.parts == int(before)
        got = trigram_search(table, asked, k=3, index=again)
        plan = again.rows.groupBy("part").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # the buckets are used
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trigram_search(table, asked, k=3, index=made).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_few_postings_are_met(spark):
    """Queries that have a near copy read a small part of what shares a trigram with them."""
    import pyarrow as pa

    r = random.Random(5)
    common = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(60)]
    lines = ["  ".join([*(r.choice(common) for _ in range(60)), *("".join(r.choice("ijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(12))]) for _ in range(3000)]
    part = Part(_part_rows(pa.table({"part": pa.array([0] * len(lines), pa.int32()), "chunk_id": list(range(len(lines))), "line": lines})))
    met = every = 0
    for i in range(0, 3000, 100):
        line = lines[i].rsplit("  ", 1)[0]
        grams = grams_of([line])[1]
        every += sum(len(p) for g, p in zip(part.grams, part.places) if g in set(grams.tolist()))
        before = part.read
        ids, similar = part.best(grams, 1)
        met += part.read - before
        assert ids[0] == i and not part.counts.any()
    assert met < every / 3


def test_reopened_tables_grow_by_batches(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert buckets.manifest_of(spark, path) is None
    buckets.create(spark, path, "k STRING, v BIGINT", "k", "k, v", 3)
    assert buckets.rows_of(spark, path).count() == 0
    for n in range(2):
        buckets.append(spark.createDataFrame([(f"k{i}", i + n) for i in range(20)], "k string, v long"), path)
    rows = buckets.rows_of(spark, path)
    assert rows.count() == 40
    joined = rows.join(spark.createDataFrame([("k3",)], "k string").hint("merge"), "k", "left_semi")
    assert joined.count() == 2
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_chunks_no_queries(spark):
    chunks, asked = spark.createDataFrame([], "chunk_id long, page_content string"), spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert trigram_search(chunks, asked).count() == 0
    some = spark.createDataFrame([(1, "word")], "chunk_id long, page_content string")
    assert trigram_search(some, asked.limit(0)).count() == 0


def test_word_line(one):
    assert one(word_line, c="Two, WORDS!\n(x)") == "two  words  x"
    assert np.array_equal(grams_of([]), (np.zeros(0), np.zeros(0)))
