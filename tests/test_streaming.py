import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chat
from corpusmill.sources import readers, writers
from corpusmill.streaming import ingest
from corpusmill.streaming.ingest import ingest_pages
from corpusmill.streaming.sessions import current_facts, keep_facts

PAGES = "page_id long, url string, html string, response_status int"


def test_pages_are_classified_batch_by_batch(spark, tmp_path):
    root, landing = str(tmp_path / "store"), str(tmp_path / "landing")

    def land(rows):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(landing)
        ingest_pages(spark.readStream.schema(PAGES).parquet(landing), root).awaitTermination()

    def buckets(batch):
        rows = spark.read.parquet(f"{root}/report").filter(F.col("batch") == batch).collect()
        return {r["url"]: r["bucket"] for r in rows}

    land([(1, "http://s/a", "<body><p>one</p></body>", 200), (2, "http://s/b", "<body><p>two</p></body>", 500)])
    land([(3, "http://s/a", "<body><p>one</p></body>", 200), (4, "http://s/b", "<body><p>two</p></body>", 200)])
    # a url that stands twice in a batch enters the catalogue once
    land([(7, "http://s/d", "<body><p>d</p></body>", 200), (8, "http://s/d", "<body><p>d2</p></body>", 200)])
    assert buckets(2) == {"http://s/d": "new"}
    land([(5, "http://s/a", "<body><p>changed</p></body>", 200), (6, "http://s/c", "<body><p>c</p></body>", 200)])
    assert buckets(0) == {"http://s/a": "new", "http://s/b": "new"}
    assert buckets(1) == {"http://s/a": "skipped", "http://s/b": "updated"}  # the failed version was not usable
    assert buckets(3) == {"http://s/a": "updated", "http://s/c": "new"}
    assert spark.read.parquet(f"{root}/catalogue").count() == 4


def test_a_batch_reads_the_buckets_of_its_urls_only(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    rows = spark.range(500).select(F.concat(F.lit("http://s/"), "id").alias("url"), F.col("id").alias("source_id"), F.lit("cr").alias("status"))
    ingest._write(rows.withColumn("bucket", ingest.bucket_of("url", 64)), path, 0)
    ingest._write(rows.limit(3).withColumn("bucket", ingest.bucket_of("url", 64)), path, 1)
    home = spark.createDataFrame([("http://s/7",)], "url string").select(ingest.bucket_of("url", 64)).first()[0]
    touched = ingest.touched_rows(spark, path, ingest.CATALOGUE, [home, 9999], 1)
    assert touched.filter("url = 'http://s/7'").count() == 1
    assert touched.inputFiles() and all(f"bucket={home}/" in f for f in touched.inputFiles())
    assert touched.count() < 50 and touched.filter("batch > 0").count() == 0
    assert ingest.touched_rows(spark, path, ingest.CATALOGUE, [9999], 1).count() == 0
    # a repeated batch replaces its own rows
    ingest._write(rows.withColumn("bucket", ingest.bucket_of("url", 64)), path, 0)
    assert spark.read.parquet(path).filter("batch = 0").count() == 500


FACTS = "session_id long, turn long, name string, value array<string>"


def plain(df):
    return {(r["session_id"], r["name"], r["item"], *r["first"]) for r in df.collect()}


def run_facts(spark, tmp_path, parts, known=None, **options):
    """Changes by batch of a stream that gets the parts one after the other."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "facts"))
        keep_facts(spark.readStream.schema(FACTS).parquet(str(tmp_path / "facts")), str(tmp_path), known, **options).awaitTermination()
    return spark.read.parquet(str(tmp_path / "changes"))


def test_streamed_facts_equal_the_batch(spark, tmp_path):
    rows = [(s, t, "need", [f"v{(s * t) % 3}", "all", ""]) for s in (1, 2) for t in range(5)]
    facts = spark.createDataFrame(rows, FACTS)
    changes = run_facts(spark, tmp_path, [facts.filter("turn >= 3"), facts.filter("turn < 3")])  # late facts move the first place
    assert plain(current_facts(changes)) == plain(chat.fact_items(facts))


def test_facts_begin_from_a_table(spark, tmp_path):
    rows = [(1, t, "need", [f"v{t % 3}", "all"]) for t in range(6)]
    facts = spark.createDataFrame(rows, FACTS)
    known = chat.fact_items(facts.filter("turn < 2")).select("session_id", "name", "item", "first.turn", F.col("first.pos").cast("long").alias("pos"))
    changes = run_facts(spark, tmp_path, [facts.filter("turn >= 4"), facts.filter("turn IN (2, 3)")], known)
    assert {r["item"] for r in changes.collect()} == {"v2"}  # all others are known
    assert plain(current_facts(changes.drop("batch").unionByName(known))) == plain(chat.fact_items(facts))


@pytest.mark.parametrize("keep_ms, again", [(1, 1), (10**9, 0)])
def test_facts_leave_the_state(spark, tmp_path, keep_ms, again):
    first, second = (spark.createDataFrame([(1, t, "need", ["x"])], FACTS) for t in (0, 5))
    changes = run_facts(spark, tmp_path, [first, second], keep_ms=keep_ms)
    assert changes.filter("batch > 0").count() == again
    assert plain(current_facts(changes)) == {(1, "need", "x", 0, 0)}


def test_facts_meet_no_python_and_state_holds_what_is_live(spark, tmp_path):
    first, second, third = (spark.createDataFrame([(1, t, "need", ["x", f"v{t}"])], FACTS) for t in (3, 5, 1))
    for part in (first, second, third):
        run_facts(spark, tmp_path, [part])
    changes = spark.read.parquet(str(tmp_path / "changes"))
    assert {(r["batch"], r["item"], r["turn"]) for r in changes.collect()} == {(0, "x", 3), (0, "v3", 3), (1, "v5", 5), (2, "x", 1), (2, "v1", 1)}
    # a bucket keeps the version that its last batch read and the one that it wrote
    for bucket in (tmp_path / "state").glob("bucket=*"):
        assert len([*bucket.glob("batch=*")]) <= 2
    # nothing but foreachBatch is called in Python: the stream keeps no state store of its own
    assert not (tmp_path / "checkpoint" / "state").exists()


def test_vector_store_appends_and_prunes(spark, tmp_path):
    path = str(tmp_path / "vectors")
    assert writers.load_vectors(spark, path).count() == 0
    schema = "chunk_id long, embedding array<float>, storage_id string, engine string"
    writers.append_vectors(spark.createDataFrame([(1, [1.0], "a", "e"), (2, [2.0], "b", "e")], schema), path)
    writers.append_vectors(spark.createDataFrame([(3, [3.0], "a", "e")], schema), path)
    assert {r["chunk_id"] for r in writers.load_vectors(spark, path, "a", "e").collect()} == {1, 3}


def test_chunks_are_appended_by_storage(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 7, "a"), (2, 8, "b")], "chunk_id long, storage_id long, page_content string")
    for _ in range(2):
        writers.append_chunks(chunks, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert stored.filter("storage_id = 7").count() == 2 and stored.count() == 4


def test_a_repeated_job_replaces_its_rows_in_few_files(spark, tmp_path):
    path = str(tmp_path / "chunks")
    chunks = spark.range(3000).repartition(20).select(F.col("id").alias("chunk_id"), F.when(F.col("id") < 2500, 1).otherwise(F.col("id") % 7).alias("storage_id"))
    for job in ("a", "a", "b", "b"):
        writers.append_by(chunks, path, ("storage_id",), job, rows_a_file=1000)
    stored = spark.read.parquet(path)
    assert stored.count() == 6000 and stored.filter("job = 'a'").count() == 3000
    files = [f for f in stored.inputFiles() if "job=a" in f]
    assert len([f for f in files if "storage_id=1/" in f]) <= 3 and len(files) <= 9


def test_files_are_hashed_block_by_block(spark, tmp_path):
    import hashlib

    contents = {"a.bin": bytes(range(256)) * 50, "b c.txt": b"y" * 100, "d%20e.txt": b"x" * 7}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r["hash"] for r in readers.file_fingerprints(spark, str(tmp_path), block=100).collect()}
    assert got == {hashlib.sha512(c).hexdigest() for c in contents.values()}


def test_quantiles_are_exact(spark):
    import random

    from corpusmill.operators.catalog import exact_quantile

    r = random.Random(3)
    rows = [(g, k, r.choice([None, r.randrange(40) / 2, 7.0])) for g, k, n in (("a", 1, 400), ("a", None, 60), ("b", 2, 1), (None, None, 33)) for _ in range(n)]
    rows += [("empty", 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, x double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {(r["g"], r["k"]): r["q"] for r in exact_quantile(df, ["g", "k"], "x", share, "q").collect()}
        want = {}
        for key in {row[:2] for row in rows}:
            values = sorted(x for *k, x in rows if tuple(k) == key and x is not None)
            if values:
                want[key] = next(v for i, v in enumerate(values, 1) if i >= share * len(values) - 1e-9)
        assert got == want


def test_catalogue_export_has_seven_columns(spark, tmp_path):
    schema = "source_id long, title string, description string, path string, url string, output_format string, status string"
    documents = spark.createDataFrame([(1, "t", None, "/p", "http://u", "f", "ready")], schema)
    writers.export_catalogue(documents, str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert rows.columns == ["id", "title", "description", "path", "link", "format", "status"]
    assert rows.first()["status"] == "Готов"


def test_files_are_listed_and_read(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("plain words", encoding="utf-8")
    (tmp_path / "in" / "deep" / "b.HTML").write_text("<p>page <b>words</b></p>", encoding="utf-8")
    (tmp_path / "in" / "c.bin").write_bytes(b"\x00")
    listed = {r["file_name"]: r["size"] for r in readers.list_files(spark, str(tmp_path / "in")).collect()}
    assert listed == {"a.txt": 11, "b.HTML": 24, "c.bin": 1}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in"))
    found = readers.extract_texts(files).withColumnRenamed("path", "doc_id")
    best = readers.best_text(files.select(F.col("path").alias("doc_id")), found).collect()
    texts = {r["doc_id"].rsplit("/", 1)[1]: (r["method"], r["text"], r["error"]) for r in best}
    assert texts["a.txt"] == ("plain", "plain words", None)
    assert texts["b.HTML"] == ("page", "page words", None)
    assert texts["c.bin"][2] == "no text recognised"


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_chunk_export(spark, tmp_path, fmt):
    chunks = spark.createDataFrame([(1, "text", {"url": "u"})], "chunk_id long, page_content string, metadata map<string,string>")
    path = str(tmp_path / fmt)
    writers.export_chunks(chunks, path, fmt)
    assert spark.read.format(fmt).load(path).count() == 1


def test_streamed_classes_of_a_url_with_several_pages(spark, tmp_path):
    from check_queries import compare, connect

    html = "<html><body><h1>T</h1><p>{}</p></body></html>"
    rows = [(n, f"http://s/{u}", html.format(n)) for n, u in ((1, "a"), (2, "b"), (7, "a"), (12, "c"), (14, "c"), (8, "b"), (4, "d"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("part-*")).rename(tmp_path / "pages.parquet")
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), "streamed_page_classes") == (10, "ok")
