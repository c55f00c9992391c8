"""One registered query for each operator, at production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import exact, fingerprints, jaccard_join, mixing, packing, prefix_trie, quality_gam, recurrent, secret_scan, sharding, tokens, toxicity, url_filter
from corpusmill.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@query
def op2_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.scores(read(spark, sf_dir, "documents"))


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(read(spark, sf_dir, "documents"))


ORACLES["op4_ngram_jaccard"] = jaccard_join.CLASSES_SQL


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"))


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


ORACLES["op9_source_mix"] = mixing.TAKEN_SQL


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(read(spark, sf_dir, "documents"))


ORACLES["op10_exact_dedup"] = exact.DEDUPLICATE_SQL


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read(spark, sf_dir, "documents"))


@query
def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_gam.judged(docs, quality_gam.fit(docs, read(spark, sf_dir, "labels")))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


@query
def op13_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


ORACLES["op13_feistel_shards"] = sharding.SHARD_SQL


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.alignment(read(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = prefix_trie.TRIE_SQL
