"""Every registered query against its SQL twin on the smallest driver tables."""

import os

import pytest
from check_queries import compare, connect, entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_its_twin(spark, con, name):
    _, verdict = compare(spark, con, SF_DIR, name)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_texts_to_test_has_every_document(spark, con):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert compare(spark, con, SF_DIR, "texts_to_test") == (n, "ok")
