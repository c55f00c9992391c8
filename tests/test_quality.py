import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import quality


def test_words_of_an_item_are_counted_in_its_row():
    words = [["b", "a", "b", "c", "a"], [], None, ["x"]] * 40
    places = [None if w is None else list(range(len(w))) for w in words]
    got = quality.counted(pa.array(words, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))).to_pylist()
    first = [("b", 2, [0, 2]), ("a", 2, [1, 4]), ("c", 1, [3])]
    assert [[tuple(w.values()) for w in row] for row in got] == [first, [], [], [("x", 1, [0])]] * 40


def test_clean_text_reads_runs_and_replaces_no_single_characters(spark):
    df = spark.createDataFrame([("  Ab, c-d!\né Ёж -- 7z ",), ("",), (None,)], "c string")
    cleaned = df.select(text.clean_text(F.col("c")).alias("t"), text.junk_ratio(F.col("c")).alias("j"))
    assert "regexp_replace" not in cleaned._jdf.queryExecution().optimizedPlan().toString()
    rows = cleaned.collect()
    assert [r["t"] for r in rows] == ["Ab c-d Ёж -- z", "", None]
    assert [r["j"] for r in rows][1:] == [0.0, None] and abs(rows[0]["j"] - 5 / 22) < 1e-9


def test_only_rare_words_are_rows_that_move(spark, monkeypatch):
    monkeypatch.setattr(quality, "FREQUENT_WORDS", 2)
    texts = spark.createDataFrame(
        [(1, "the cat, the zub zub dog"), (2, "the dog"), (2, "cat! lone"), (3, "12 ?"), (4, None)], "item_id long, text string"
    )
    rows = {(r["item_id"], r["total_chars"]): r for r in quality.quality_report(texts).collect()}
    assert rows[1, 24]["invalid"] == ["zub", "zub"] and rows[1, 24]["valid_words"] == 4
    assert [tuple(w) for w in rows[1, 24]["frequent"]] == [(1, "the", 2), (2, "zub", 2), (3, "cat", 1), (4, "dog", 1)]
    assert rows[2, 7]["invalid"] == ["lone"] and rows[2, 7]["total_words"] == 4
    assert rows[3, 4]["error"] == quality.EMPTY and rows[3, 4]["invalid"] is None and rows[4, None]["error"] == quality.EMPTY
    own = quality.quality_report(texts, spark.createDataFrame([("zub",), ("absent",)], "word string"))
    assert {r["item_id"]: r["invalid"] for r in own.collect()}[1] == ["the", "cat", "the", "dog"]
    labelled = spark.createDataFrame([("en", "the cat the dog lone"), ("xx", "zub zub cat")], "lang string, text string")
    profiles = quality.language_profiles(labelled)
    found = {r["item_id"]: r["detected"] for r in quality.detect_language(texts, profiles).collect()}
    assert found == {1: "xx", 2: "en", 3: None, 4: None}


def test_model_sees_every_chunk_once(spark):
    from corpusmill.operators import embed, search
    from corpusmill.plans import flows

    seen = spark.sparkContext.accumulator(0)

    def model():
        encode = embed.word_hash_model()

        def counting(texts):
            assert len(texts) <= 8
            seen.add(len(texts))
            return encode(texts)

        return counting

    rows = [(i, "s", f"text number {i}", {}) for i in range(600)]
    contents = spark.createDataFrame(rows, "content_id long, storage_id string, body string, metadata map<string,string>").coalesce(1)
    chunks, vectors = flows.chunk_and_embed(contents, "recursive", {"chunk_size": 20, "chunk_overlap": 0}, "e", model)
    asked = vectors.filter("chunk_id % 100 = 0").select(vectors.chunk_id.alias("query_id"), "embedding")
    hits = search.nearest(vectors, asked, k=1).collect()
    assert seen.value == chunks.count() == 600 and all(h["distance"] < 1e-6 for h in hits)
    blank = embed.embed_chunks(spark.createDataFrame([(1, "s", " \n")], "chunk_id long, storage_id string, page_content string"), "e", model)
    assert set(blank.first()["embedding"]) == {0.0}
