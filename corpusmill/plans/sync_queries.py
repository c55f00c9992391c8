"""Change capture and lifecycle queries.

The catalogue knows every document but the Spanish ones; the incoming listing holds every document but
the German ones, and those of two sources come with changed text.
"""

from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.operators import sync
from corpusmill.plans.registry import query, table
from corpusmill.plans.standins import standin, with_sql

SNAPSHOTS_SQL = """WITH d AS (SELECT doc_id, lang, source, text, 'http://' || source || '/' || doc_id AS url, quality, toxic
    FROM documents LEFT JOIN labels USING (doc_id)),
  catalogue AS (SELECT doc_id AS source_id, url, source, CASE WHEN toxic = 1 THEN 'ex' WHEN quality = 0 THEN 'de' WHEN quality = 1 THEN 'ready' ELSE 'active' END AS status
    FROM d WHERE lang <> 'es'),
  contents AS (SELECT doc_id AS source_id, doc_id * 2 + v AS content_id, CASE WHEN v = 0 THEN sha256(text || ' old') ELSE sha256(text) END AS hash,
      CASE WHEN v = 1 AND toxic = 0 AND quality = 1 THEN 'error' ELSE 'ready' END AS status, v
    FROM d, unnest([0, 1]) AS u(v) WHERE lang <> 'es'),
  latest AS (SELECT source_id, content_id AS old_content_id, hash AS old_hash FROM contents WHERE status = 'ready'
    QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY v DESC) = 1),
  incoming AS (SELECT doc_id, url, source, text || CASE WHEN source IN ('src1', 'src2') THEN ' changed' ELSE '' END AS body FROM d WHERE lang <> 'de')
"""


def snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.withColumn("url", F.concat(F.lit("http://"), "source", F.lit("/"), "doc_id"))
    status = F.when(F.col("toxic") == 1, "ex").when(F.col("quality") == 0, "de").when(F.col("quality") == 1, "ready")
    known = d.filter("lang <> 'es'")
    catalogue = known.select(
        F.col("doc_id").alias("source_id"), "url", "source", F.coalesce(status, F.lit("active")).alias("status")
    )
    failed = (F.col("v") == 1) & (F.col("toxic") == 0) & (F.col("quality") == 1)
    body = F.when(F.col("v") == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    contents = known.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("doc_id").alias("source_id"),
        (F.col("doc_id") * 2 + F.col("v")).alias("content_id"),
        F.sha2(body, 256).alias("hash"),
        F.when(failed, "error").otherwise("ready").alias("status"),
        F.col("v").alias("created_at"),
    )
    changed = F.when(F.col("source").isin("src1", "src2"), F.lit(" changed")).otherwise("")
    incoming = d.filter("lang <> 'de'").select("doc_id", "url", "source", F.concat("text", changed).alias("body"))
    return catalogue, contents, incoming


BUCKET_SQL = """CASE WHEN c.source_id IS NULL THEN 'new' WHEN c.status = 'de' THEN 'restored' WHEN c.status = 'ex' THEN 'excluded'
    WHEN sha256(i.body) IS NOT DISTINCT FROM l.old_hash THEN 'skipped' ELSE 'updated' END"""
CLASSIFIED_SQL = f""", classified AS (SELECT i.url, c.source_id, i.doc_id, {BUCKET_SQL} AS bucket FROM incoming i LEFT JOIN catalogue c USING (url)
    LEFT JOIN latest l ON l.source_id = c.source_id)"""


def classified(spark, sf_dir):
    catalogue, contents, incoming = snapshots(spark, sf_dir)
    code = F.when(F.col("source") == "src3", 404).otherwise(200)
    fetched = incoming.withColumns({"hash": F.sha2("body", 256), "response_status": code})
    return sync.classify_fetched(fetched, catalogue, contents)


@query(
    "J8, U1",
    SNAPSHOTS_SQL
    + """SELECT coalesce(i.url, c.url) AS url, c.source_id, CASE WHEN c.url IS NULL THEN 'new' WHEN i.url IS NULL THEN 'deleted' ELSE 'existing' END AS bucket
         FROM incoming i FULL JOIN catalogue c ON c.url = i.url""",
)
def full_listing_classes(spark, sf_dir):
    catalogue, _, incoming = snapshots(spark, sf_dir)
    return sync.classify_listing(incoming, catalogue).select("url", "source_id", "bucket")


@query(
    "J8",
    SNAPSHOTS_SQL
    + "SELECT i.url, c.source_id, CASE WHEN c.url IS NULL THEN 'new' ELSE 'existing' END AS bucket FROM incoming i LEFT JOIN catalogue c ON c.url = i.url",
)
def partial_listing_classes(spark, sf_dir):
    catalogue, _, incoming = snapshots(spark, sf_dir)
    return sync.classify_listing(incoming, catalogue, full=False).select("url", "source_id", "bucket")


@query("J9", SNAPSHOTS_SQL + CLASSIFIED_SQL + " SELECT url, source_id, bucket FROM classified")
def fetched_page_classes(spark, sf_dir):
    return classified(spark, sf_dir).select("url", "source_id", "bucket")


@query(
    "J10, J2",
    SNAPSHOTS_SQL
    + """SELECT i.doc_id AS source_id, l.old_content_id FROM incoming i LEFT JOIN latest l ON l.source_id = i.doc_id
         WHERE sha256(i.body) IS DISTINCT FROM l.old_hash""",
)
def changed_file_sources(spark, sf_dir):
    _, contents, incoming = snapshots(spark, sf_dir)
    current = incoming.select(F.col("doc_id").alias("source_id"), F.sha2("body", 256).alias("hash"))
    return sync.changed_files(current, contents).select("source_id", "old_content_id")


_REASONS = "CASE c.status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CHANGE_REASON.items()) + " END"


@query(
    "M1",
    SNAPSHOTS_SQL
    + f"""SELECT c.source_id, l.old_content_id, c.source_id * 2 + 2 AS new_content_id, c.status AS previous_status, {_REASONS} AS description
          FROM incoming i JOIN catalogue c USING (url) LEFT JOIN latest l ON l.source_id = c.source_id
          WHERE sha256(i.body) IS DISTINCT FROM l.old_hash AND {_REASONS} IS NOT NULL""",
)
def opened_change_tasks(spark, sf_dir):
    catalogue, contents, incoming = snapshots(spark, sf_dir)
    current = incoming.withColumn("hash", F.sha2("body", 256)).join(catalogue.select("url", "source_id", "status"), "url")
    changed = sync.changed_files(current, contents).withColumn("content_id", F.col("source_id") * 2 + 2)
    return sync.change_tasks(changed).drop("status")


@query(
    "M2",
    """WITH t AS (SELECT event_id, user_id AS source_id, CASE event_type WHEN 'view' THEN 'created' WHEN 'click' THEN 'rejected' ELSE 'solved' END AS status,
         'after-' || event_type AS next_status, ts, value > 200 AS busy FROM events),
       v AS (SELECT source_id, count(*) FILTER (WHERE status = 'created' AND busy) AS n_open,
         arg_max(next_status, (ts, event_id)) FILTER (WHERE status <> 'created') AS next FROM t GROUP BY 1)
       SELECT c_custkey AS source_id, CASE WHEN n_open > 0 THEN 'wait' ELSE coalesce(next, c_mktsegment) END AS status
       FROM customer LEFT JOIN v ON v.source_id = c_custkey""",
)
def sources_after_tasks(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when((kind == "view") & (F.col("value") > 200), "created").when(kind == "click", "rejected").when(
        kind == "view", "on hold").otherwise("solved")
    tasks = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"), F.col("user_id").alias("source_id"), status.alias("status"),
        F.concat(F.lit("after-"), kind).alias("next_status"), F.col("ts").alias("finished_at"),
    )
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("status"))
    return sync.resolve_sources(sources, tasks)


@query(
    "M3",
    """WITH c AS (SELECT l_orderkey AS source_id, l_orderkey || '/' || l_returnflag AS content_id, l_linestatus = 'F' AND l_discount > 0.05 AS embedded FROM lineitem),
         hit AS (SELECT DISTINCT source_id FROM c WHERE embedded)
       SELECT o_orderkey AS source_id, CASE WHEN o_orderkey IN (SELECT source_id FROM hit) THEN 'active' ELSE o_orderstatus END AS status FROM orders""",
)
def activated_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    chunk_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    content_id = F.concat_ws("/", "l_orderkey", "l_returnflag")
    chunks = lines.select(chunk_id.alias("chunk_id"), content_id.alias("content_id"), F.lit("ready").alias("status"))
    vectors = lines.filter("l_linestatus = 'F' AND l_discount > 0.05").select(chunk_id.alias("chunk_id"))
    contents = lines.select(
        content_id.alias("content_id"), F.col("l_orderkey").alias("source_id"), F.lit("ready").alias("status")
    ).distinct()
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("status"))
    return sync.activate(sources, contents, chunks, vectors)["sources"]


@query(
    "M4",
    """SELECT page_id, CASE WHEN length(url) > 40 THEN 'er' ELSE 'cr' END AS source_status,
         CASE WHEN length(url) > 40 THEN 'error' ELSE 'ready' END AS content_status FROM pages""",
)
def statuses_by_response(spark, sf_dir):
    code = F.when(F.length("url") > 60, F.lit(None)).when(F.length("url") > 40, 503).otherwise(200)
    return table(spark, sf_dir, "pages").select(
        "page_id", *[c.alias(n) for n, c in sync.fetch_status(code).items()]
    )


@query(
    "M5",
    SNAPSHOTS_SQL
    + """SELECT source_id, content_id, hash FROM contents WHERE source_id NOT IN (SELECT doc_id FROM incoming WHERE source = 'src1')
         UNION ALL SELECT doc_id, doc_id * 2 + 2, sha256(body) FROM incoming WHERE source = 'src1'""",
)
def replaced_contents(spark, sf_dir):
    _, contents, incoming = snapshots(spark, sf_dir)
    derived = incoming.filter("source = 'src1'").select(
        F.col("doc_id").alias("source_id"), (F.col("doc_id") * 2 + 2).alias("content_id"), F.sha2("body", 256).alias("hash")
    )
    return sync.replace_derived(contents.select("source_id", "content_id", "hash"), derived, "source_id")


@query(
    "M6",
    """WITH i AS (SELECT user_id, event_type, value, ts, event_id FROM events WHERE event_type <> 'view'
         QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
       e AS (SELECT user_id, 'view' AS event_type, 0.0::DOUBLE AS value, -1 AS event_id FROM events UNION SELECT user_id, 'click', 0.0, -1 FROM events)
       SELECT coalesce(i.user_id, e.user_id) AS user_id, coalesce(i.event_type, e.event_type) AS event_type,
         coalesce(i.value, e.value) AS value, coalesce(i.event_id, e.event_id)::BIGINT AS event_id
       FROM i FULL JOIN e ON e.user_id = i.user_id AND e.event_type = i.event_type""",
)
def upserted_settings(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    existing = events.select(
        "user_id", F.explode(F.array(F.lit("view"), F.lit("click"))).alias("event_type"), F.lit(0.0).alias("value"),
        F.lit(-1).cast("long").alias("event_id"),
    ).distinct()
    return sync.upsert(existing, events.filter("event_type <> 'view'"), ["user_id", "event_type"], "event_id")


@query(
    "M7, P8",
    with_sql("storages", "sources")
    + """SELECT source_id, CASE WHEN t.storage_type = 'BUILDING' THEN true WHEN t.storage_type = 'MACHINERY' THEN false ELSE s.status = 'ready' END AS is_deleted,
         CASE WHEN t.storage_type = 'BUILDING' THEN '2024-06-01' WHEN t.storage_type = 'MACHINERY' THEN NULL
              WHEN s.status = 'ready' THEN strftime(s.created_at, '%Y-%m-%d') END AS deleted_day
       FROM sources s LEFT JOIN storages t USING (storage_id)""",
)
def cascaded_deletions(spark, sf_dir):
    kind = F.col("storage_type")
    parents = standin(spark, sf_dir, "storages").withColumn(
        "action", F.when(kind == "BUILDING", "delete").when(kind == "MACHINERY", "restore")
    )
    children = standin(spark, sf_dir, "sources").select(
        "source_id", "storage_id", (F.col("status") == "ready").alias("is_deleted"),
        F.when(F.col("status") == "ready", F.col("created_at")).alias("deleted_at"),
    )
    at = F.lit("2024-06-01").cast("timestamp")
    after = sync.cascade_deletion(parents, children, "storage_id", at)
    return after.select("source_id", "is_deleted", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_day"))


@query(
    "M8",
    """SELECT c_custkey AS storage_id, 'update' AS action, '{' || concat_ws(',',
         CASE WHEN c_acctbal < 0 THEN '"name":{"from":"' || c_name || '","to":"' || c_name || ' closed"}' END,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '"kind":{"from":"BUILDING","to":"HOUSING"}' END) || '}' AS changes
       FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'""",
)
def field_change_log(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("storage_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"),
        F.lit(1).alias("updated_at"), F.col("c_acctbal").alias("balance"),
    )
    new = old.withColumns(
        {
            "name": F.when(F.col("balance") < 0, F.concat("name", F.lit(" closed"))).otherwise(F.col("name")),
            "kind": F.when(F.col("kind") == "BUILDING", "HOUSING").otherwise(F.col("kind")),
            "updated_at": F.lit(2),
        }
    )
    return sync.field_changes(old.drop("balance"), new.drop("balance"), "storage_id")


@query("M9", SNAPSHOTS_SQL + CLASSIFIED_SQL + " SELECT 7::BIGINT AS report_id, bucket, url AS item_id FROM classified")
def sync_report_items(spark, sf_dir):
    return sync.report_items(classified(spark, sf_dir), 7, "url")


@query("M9", SNAPSHOTS_SQL + CLASSIFIED_SQL + " SELECT 7::BIGINT AS report_id, bucket, count(*) AS n_items FROM classified GROUP BY 2")
def sync_report_totals(spark, sf_dir):
    return sync.report_totals(sync.report_items(classified(spark, sf_dir), 7, "url"))


@query(
    "J9, M4, S11",
    SNAPSHOTS_SQL
    + CLASSIFIED_SQL
    + """ SELECT k.url, k.source_id, sha256(i.body) AS hash, CASE WHEN i.source = 'src3' THEN 'error' ELSE 'ready' END AS status, 7::BIGINT AS report_id
         FROM classified k JOIN incoming i USING (url) WHERE bucket IN ('new', 'updated')""",
)
def appended_content_versions(spark, sf_dir):
    return sync.new_versions(classified(spark, sf_dir), 7).drop("body")
