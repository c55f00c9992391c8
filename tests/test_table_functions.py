import sys

import pytest
from pyspark import cloudpickle

from corpusmill.operators import chunking
from corpusmill.operators import table_functions as tf

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests


class Halves(tf.SplitterPlugin):
    config_schema = {"mark": {"type": str, "required": True}}

    def split(self, metadata, text):
        left, _, right = text.partition(self.config["mark"])
        return [(left, {"side": "left"}), (right, {"side": "right"})]


class Total(tf.GroupPlugin):
    schema = "key string, n int"

    def __init__(self):
        self.key, self.n = None, 0

    def row(self, row):
        self.key, self.n = row["key"], self.n + 1
        return ()

    def end(self):
        return [(self.key, self.n)]


def test_settings_are_checked():
    with pytest.raises(TypeError):
        type("NoSchema", (tf.SplitterPlugin,), {"split": lambda self, m, t: []})({})
    for wrong in ({}, {"mark": "-", "size": 3}):
        with pytest.raises(ValueError):
            Halves(wrong)


def test_a_plugin_runs_in_a_chunk_job(spark):
    name = tf.register_splitter_plugin(Halves, {"mark": "|"})
    try:
        with pytest.raises(ValueError):
            tf.register_splitter_plugin(Halves, {"mark": "|"})
        contents = spark.createDataFrame([(1, "a|b", {"url": "u"})], "content_id long, body string, metadata map<string,string>")
        rows = chunking.chunk_contents(contents, name, {}).orderBy("ordinal").collect()
        assert [(r["page_content"], r["metadata"]["side"], r["metadata"]["url"]) for r in rows] == [("a", "left", "u"), ("b", "right", "u")]
    finally:
        del tf.SPLITTER_PLUGINS[name], chunking.SPLITTERS[name]


def test_a_splitter_is_a_table_in_sql(spark):
    tf.splitter_function(spark, "halves", Halves, {"mark": "|"})
    spark.createDataFrame([(1, "a|b"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, h.* FROM texts, LATERAL halves(text, map('k', 'v')) h ORDER BY id, ordinal").collect()
    assert [(r["id"], r["ordinal"], r["page_content"], r["metadata"]) for r in rows] == [
        (1, 0, "a", {"k": "v", "side": "left"}), (1, 1, "b", {"k": "v", "side": "right"}),
        (3, 0, "", {"k": "v", "side": "left"}), (3, 1, "", {"k": "v", "side": "right"}),
    ]


def test_groups_keep_apart(spark):
    tf.group_function(spark, "totals", Total)
    spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), (None, 2)], "key string, place int").createOrReplaceTempView("places")
    rows = spark.sql("SELECT * FROM totals(TABLE(places) PARTITION BY key ORDER BY place)").collect()
    assert {(r["key"], r["n"]) for r in rows} == {("a", 5), ("b", 1), (None, 1)}


def test_broken_files_have_no_text(spark):
    tf.extractor_function(spark)
    spark.createDataFrame([(bytearray(b"<p>x"), "html"), (None, "txt"), (bytearray(b"y"), "bin")], "content binary, extension string").createOrReplaceTempView("files")
    rows = spark.sql("SELECT x.* FROM files, LATERAL extracted(content, extension) x").collect()
    assert [(r["method"], r["text"]) for r in rows] == [("page", "x")]
