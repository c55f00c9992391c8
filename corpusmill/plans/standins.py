"""The library's tables seen in the driver's tables.

The column expressions are valid in both SQL dialects, so that a query and its twin start from the
same rows.
"""

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans.registry import table

STANDINS = {
    "corpora": ("nation", ["n_nationkey AS kb_id", "n_name AS name", "n_regionkey AS group_id"]),
    "owners": ("customer", ["c_nationkey AS kb_id", "c_custkey AS user_id"]),
    "storages": (
        "customer",
        [
            "c_custkey AS storage_id", "c_mktsegment AS storage_type", "c_nationkey AS kb_id",
            "c_name AS name", "c_acctbal < 0 AS is_deleted",
        ],
    ),
    "sources": (
        "orders",
        [
            "o_orderkey AS source_id", "o_custkey AS storage_id",
            "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'ready' ELSE 'xx' END AS status",
            "o_orderpriority AS title", "'http://host/' || o_orderkey AS url", "o_orderdate AS created_at",
        ],
    ),
    "contents": (
        "lineitem",
        [
            "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS content_id",
            "l_orderkey AS source_id",
            "CASE l_returnflag WHEN 'R' THEN 'raw' WHEN 'A' THEN 'cleaned' ELSE 'url' END AS content_type",
            "CASE l_linestatus WHEN 'F' THEN 'active' ELSE 'ready' END AS status",
            "CAST(l_quantity AS INT) AS size_in_tokens", "l_shipdate AS created_at",
        ],
    ),
    "jobs": ("events", ["event_id", "user_id AS job_id", "event_type", "ts"]),
    "texts": (
        "documents",
        [
            "doc_id AS source_id", "source AS storage_id", "lang", "text AS body",
            "'http://' || source || '.example.com/' || doc_id AS url", "n_chars",
        ],
    ),
}


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = STANDINS[name]
    return table(spark, sf_dir, base).selectExpr(*columns)


def with_sql(*names: str) -> str:
    """WITH clause defining the named stand-ins for the SQL twin."""
    parts = [f"{n} AS (SELECT {', '.join(STANDINS[n][1])} FROM {STANDINS[n][0]})" for n in names]
    return "WITH " + ", ".join(parts) + " "
