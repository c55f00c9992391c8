import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions.splitting import count_words, recursive_split, split_text
from corpusmill.operators import chunking as ch


@given(st.text(alphabet="ab .\n-", max_size=300), st.integers(2, 12))
@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
def test_recursive_split_keeps_words_and_size(text, size):
    chunks = split_text(text, size, 0)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(count_words(c) <= size for c in chunks)


def test_recursive_split_overlaps():
    chunks = split_text("a b c d e f g", 3, 1)
    assert chunks == ["a b c", "c d e", "e f g"]
    assert split_text("one\n\ntwo two\n\nthree", 2, 0) == ["one", "two two", "three"]


def sections(one, text, levels):
    return [(s["text"], [p["name"] for p in s["path"]]) for s in one(lambda t: ch.header_sections(t, levels), t=text)]


def test_header_sections(one):
    text = "intro\n# A\nx\n\ny\n## B\nz\n# C\n## D\nlast"
    assert sections(one, text, [1, 2]) == [
        ("intro", []),
        ("# A\nx  \ny", ["A"]),
        ("## B\nz", ["A", "B"]),
        ("# C  \n## D\nlast", ["C", "D"]),
    ]
    assert sections(one, text, [1])[1] == ("# A\nx  \ny\n## B\nz", ["A"])


def test_headings_in_fences_do_not_count(one):
    found = sections(one, "# A\n```\n# no\n```\nb\n# C\nd", [1])
    assert [p for _, p in found] == [["A"], ["C"]]
    assert "# no" in found[0][0]


def test_short_tail_is_merged_once(one):
    def merged(a):
        chunks = F.array(
            F.struct(F.lit("a b c d e f").alias("text"), F.lit(6).alias("n_tokens")),
            F.struct(a.alias("text"), F.lit(3).alias("n_tokens")),
        )
        return ch.merge_short_tail(chunks, 10, 40, 3)

    assert [c["text"] for c in one(merged, a="e f g")] == ["a b c d e f g"]
    assert [c["text"] for c in one(merged, a="x y z")] == ["a b c d e fx y z"]


def test_merge_small(one):
    def merged(a):
        sizes = {"a": 2, "b": 3, "c": 9, "d": 1, "e": 8, "f": 2}
        chunks = F.array(*[F.struct(F.lit(" ".join([t] * n)).alias("text"), F.lit(n).alias("n_tokens")) for t, n in sizes.items()])
        return ch.merge_small(chunks, 5, 8)

    assert [c["n_tokens"] for c in one(merged, a=1)] == [5, 9, 1, 8, 2]


def test_fixed_windows(one):
    assert one(lambda t: ch.fixed_windows(t, 10, 2), t="x" * 18) == ["x" * 10, "x" * 10]
    assert one(lambda t: ch.fixed_windows(t, 10, 2), t="") == [""]


@pytest.fixture
def contents(spark):
    rows = [(1, "# One\n" + "a b c. " * 40), (2, "short text"), (3, "  "), (4, None)]
    df = spark.createDataFrame(rows, "content_id long, body string")
    return df.withColumn("metadata", F.create_map(F.lit("url"), F.lit("http://u")))


def test_chunk_job_and_quarantine(contents):
    rows = ch.chunk_contents(ch.usable(contents), "recursive", {"chunk_size": 30, "chunk_overlap": 5}, report_id=3).collect()
    assert {r["content_id"] for r in rows} == {1, 2}
    assert all(r["size_in_tokens"] <= 30 and r["metadata"]["url"] == "http://u" and r["report_id"] == 3 for r in rows)
    ordinals = sorted(r["ordinal"] for r in rows if r["content_id"] == 1)
    assert ordinals == list(range(len(ordinals)))
    assert {r["content_id"] for r in ch.unusable(contents).collect()} == {3, 4}


def test_plugged_in_splitter(contents):
    ch.register_splitter("words", ch.python_splitter(lambda t, c: [(w, {"w": w}) for w in t.split()]))
    rows = ch.chunk_contents(ch.usable(contents).filter("content_id = 2"), "words", {}).collect()
    assert [(r["page_content"], r["metadata"]["w"]) for r in rows] == [("short", "short"), ("text", "text")]


def test_legal_split_falls_back_and_merges(contents):
    rows = ch.chunk_contents(ch.usable(contents), "legal", {"min_chunk_size": 40, "max_chunk_size": 90, "drop_below": 2}).collect()
    assert {r["content_id"] for r in rows} == {1, 2}
    assert all("high_quality" in r["metadata"] for r in rows)


def test_texts_of_a_batch_are_split_in_slices(spark):
    class Caught:
        """Stands for a table: hands out the function that would run over its batches."""

        schema = spark.range(0).schema

        def withColumn(self, name, column):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = recursive_split(Caught(), F.array("text"), 20, 0, -1)
    texts = [f"word{i} " * 400 for i in range(2000)]
    jobs = pa.array([{"sections": [t], "size": 20, "overlap": 0, "keep": -1} for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), jobs], ["id", "_task"])
    tracemalloc.start()
    try:
        cut = [b.column("_cut") for b in run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [" ".join(p["text"] for p in pieces) for b in cut for pieces in b.to_pylist()] == [t.strip() for t in texts]
    assert peak < batch.nbytes / 3


def test_only_what_is_needed_travels_through_python(spark, contents):
    usable = ch.usable(contents).withColumns({"other": F.lit("x"), "storage_id": F.lit("s")})
    for splitter in ("recursive", "legal"):
        chunks = ch.chunk_contents(usable, splitter, {}, carry=("storage_id",))
        passes = [line for line in chunks._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in line]
        last = passes[0].split("[", 1)[1]  # the columns that come out of the last pass
        assert passes and "other" not in "".join(passes) and "body" not in last
        assert {r["storage_id"] for r in chunks.collect()} == {"s"}
        carried = ch.chunk_contents(usable, splitter, {}, carry=("body",))
        assert set(carried.select("content_id", "body").collect()) <= set(usable.select("content_id", "body").collect())


def test_words_of_a_text_and_its_chunks_are_counted_in_its_row():
    from corpusmill.plans.chunk_queries import shared_counts

    own = [["a", "b", "a"], [], ["x"], None] * 50
    got = [["a", "c", "b", "b"], ["z"], ["x", "x", "x"], None] * 50
    counts = shared_counts(pa.array(own, pa.list_(pa.string())), pa.array(got, pa.list_(pa.string()))).to_pylist()
    each = [(2, 1, 1), (0, 1, 0), (1, 0, 2), (0, 0, 0)]
    assert [tuple(c.values()) for c in counts] == each * 50


def test_kept_words_never_become_rows(spark, contents):
    from corpusmill.plans.chunk_queries import _kept

    usable = ch.usable(contents)
    checked = _kept(ch.chunk_contents(usable, "recursive", {"chunk_size": 20, "chunk_overlap": 0}), usable, 20, 0)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan
    assert all(r["fits"] and r["numbered"] and r["repeats_fit"] and r["n_foreign"] == 0 for r in checked.collect())


def test_texts_and_metadata_of_page_chunks_count(spark, tmp_path):
    from corpusmill.plans.chunk_queries import page_chunks

    page = "<html><body><main><h1>{}</h1><p>{}</p><h1>B</h1><p>{}</p><p>{}</p></main></body></html>"
    one, two, link = "one two three", "four five six", "<a href='/f.pdf'>{}</a>"
    rows = [
        (1, page.format("T", one, two, link.format("x"))),
        (2, page.format("T", one, two, link.format("x"))),
        (3, page.format("T", two, one, link.format("x"))),  # the same pieces in another order
        (4, page.format("U", one, two, link.format("x"))),  # another header
        (5, page.format("T", one, two, link.format("y"))),  # another file
        (6, page.format("T", one, two, link.format("x"))),
        (6, page.format("T", one, two, link.format("x"))),  # a page that stands twice
    ]
    spark.createDataFrame([(i, "http://u/p", html) for i, html in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["content_id"]: r for r in page_chunks(spark, str(tmp_path)).collect()}
    prints = {i: r["fingerprint"] for i, r in got.items()}
    assert len({(r["n_chunks"], r["n_tokens"]) for i, r in got.items() if i < 6}) == 1  # sizes alone do not tell them apart
    assert prints[1] == prints[2] and len({prints[i] for i in (1, 3, 4, 5, 6)}) == 5 and got[6]["n_chunks"] == 2 * got[1]["n_chunks"]
