"""Relational queries over the catalogue."""

from pyspark.sql import functions as F

from corpusmill.functions import fixed, meta, text
from corpusmill.operators import catalog as cat
from corpusmill.plans.registry import query, table
from corpusmill.plans.standins import standin, with_sql

LABELS_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SOURCE_STATUS.items()) + " ELSE {0} END"
DAY = "strftime({}, '%Y-%m-%d')"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


# ---- P: predicates and projections ----


@query("P1, P17", with_sql("texts") + "SELECT source_id, url FROM texts WHERE contains(lower(body), 'tion') OR contains(lower(url), 'tion')")
def substring_search(spark, sf_dir):
    return cat.matching(standin(spark, sf_dir, "texts"), "TION", ["body", "url"]).select("source_id", "url")


@query("P2", with_sql("sources") + "SELECT source_id, status FROM sources WHERE status IN ('active', 'ready')")
def sources_with_status(spark, sf_dir):
    wanted = cat.with_status(standin(spark, sf_dir, "sources"), ["active", "ready", "xx", "nope"], fixed.SOURCE_STATUS)
    return wanted.select("source_id", "status")


@query(
    "P3",
    with_sql("sources", "contents")
    + """SELECT source_id, title FROM sources s WHERE EXISTS (SELECT 1 FROM contents c WHERE c.source_id = s.source_id
         AND c.content_type = 'raw')""",
)
def sources_with_any_tag(spark, sf_dir):
    contents = standin(spark, sf_dir, "contents").withColumn("tags", F.array("content_type", "status"))
    return cat.with_any_tag(standin(spark, sf_dir, "sources"), contents, ["raw", "other"]).select("source_id", "title")


@query(
    "P4",
    with_sql("sources") + "SELECT source_id FROM sources WHERE created_at >= TIMESTAMP '1996-03-01' AND created_at <= TIMESTAMP '1998-03-01'",
)
def sources_created_between(spark, sf_dir):
    sources = cat.created_between(standin(spark, sf_dir, "sources"), "1996-03-01", "1998-03-01")
    return cat.created_between(sources, "not a date", None).select("source_id")


@query("P5", with_sql("texts") + "SELECT source_id, url FROM texts WHERE length(body) BETWEEN 500 AND 3000")
def sources_with_body_length(spark, sf_dir):
    texts = standin(spark, sf_dir, "texts")
    versions = texts.select("source_id", "body").union(texts.select("source_id", F.col("body")))
    return cat.with_body_length(texts, versions, 500, 3000).select("source_id", "url")


@query(
    "P6, P7",
    with_sql("sources") + "SELECT source_id, title FROM sources ORDER BY title DESC, source_id LIMIT 50 OFFSET 100",
)
def sorted_source_page(spark, sf_dir):
    order = cat.sort_columns("-title", ["title", "created_at"], "source_id")
    return cat.page_of(standin(spark, sf_dir, "sources").select("source_id", "title"), "3", 50, order)


@query(
    "P6, P7",
    with_sql("sources")
    + """SELECT source_id, title FROM (SELECT source_id, title, row_number() OVER (ORDER BY title, source_id) AS r,
         count(*) OVER () AS n FROM sources) WHERE r > ((n - 1) // 64) * 64""",
)
def last_source_page(spark, sf_dir):
    order = cat.sort_columns("unknown", ["title", "created_at"], "source_id")
    return cat.page_of(standin(spark, sf_dir, "sources").select("source_id", "title"), 10**9, 64, order)


@query("P8", with_sql("storages") + "SELECT storage_id, CASE WHEN is_deleted THEN 'deleted' ELSE 'live' END AS seen_in FROM storages")
def storages_by_visibility(spark, sf_dir):
    storages = standin(spark, sf_dir, "storages")
    parts = [cat.visible(storages, m).select("storage_id", F.lit(m).alias("seen_in")) for m in ("live", "deleted")]
    return parts[0].union(parts[1])


@query(
    "P9",
    with_sql("texts")
    + "SELECT source_id, left(body, 200) AS preview, length(body)::BIGINT AS n_chars, coalesce(substr(body, 1, 301), '') AS opening FROM texts",
)
def text_previews(spark, sf_dir):
    return standin(spark, sf_dir, "texts").select(
        "source_id",
        text.preview(F.col("body")).alias("preview"),
        F.length("body").cast("long").alias("n_chars"),
        F.coalesce(F.substring("body", 1, 301), F.lit("")).alias("opening"),
    )


@query(
    "P10, A5",
    with_sql("sources") + f"SELECT status, {LABELS_SQL.format('status')} AS label, count(*) AS n FROM sources GROUP BY status",
)
def sources_per_status(spark, sf_dir):
    counted = standin(spark, sf_dir, "sources").groupBy("status").agg(F.count("*").alias("n"))
    return counted.withColumn("label", meta.label_of(F.col("status"), fixed.SOURCE_STATUS)).orderBy("status")


@query("P11", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k')::DOUBLE / 4 AS quarter FROM events")
def json_paths(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k.cast("double") / 4).alias("quarter"))


@query("P12", with_sql("corpora", "owners") + "SELECT kb_id, name FROM corpora WHERE kb_id IN (SELECT kb_id FROM owners WHERE user_id = 7)")
def owned_corpora(spark, sf_dir):
    corpora = cat.owned_by(standin(spark, sf_dir, "corpora"), standin(spark, sf_dir, "owners"), 7)
    return corpora.select("kb_id", "name")


@query(
    "P13",
    with_sql("contents", "sources", "storages")
    + """SELECT c.content_id, c.source_id FROM contents c JOIN sources USING (source_id) JOIN storages USING (storage_id)
         WHERE c.status = 'active' AND kb_id = 3""",
)
def chunks_of_one_corpus(spark, sf_dir):
    contents = standin(spark, sf_dir, "contents")
    by_type = [F.when(F.col("content_type") == t, F.col("source_id")).alias(f"{t}_source") for t in ("raw", "cleaned", "url")]
    chunks = contents.select("content_id", "status", *by_type)
    paths = ["raw_source", "cleaned_source", "url_source"]
    found = cat.chunks_of_corpus(chunks, paths, standin(spark, sf_dir, "sources"), standin(spark, sf_dir, "storages"), 3)
    return found.select("content_id", "source_id")


@query(
    "P14",
    with_sql("contents")
    + """SELECT content_id, (CASE WHEN content_type = 'raw' THEN 1 ELSE 0 END + CASE WHEN status = 'active' THEN 1 ELSE 0 END)::BIGINT AS n_set
         FROM contents WHERE (content_type = 'raw') = (status = 'active')""",
)
def exactly_one_violations(spark, sf_dir):
    contents = standin(spark, sf_dir, "contents").select(
        "content_id",
        F.when(F.col("content_type") == "raw", F.col("source_id")).alias("raw_id"),
        F.when(F.col("status") == "active", F.col("source_id")).alias("active_id"),
    )
    return cat.not_exactly_one(contents, ["raw_id", "active_id"]).select("content_id", F.col("n_set").cast("long").alias("n_set"))


@query(
    "P15",
    with_sql("contents")
    + """SELECT source_id, created_day, count(*) AS n FROM (SELECT source_id, CASE WHEN content_type <> 'url'
         THEN strftime(created_at, '%Y-%m-%d') END AS created_day FROM contents) WHERE created_day IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_key_violations(spark, sf_dir):
    keyed = standin(spark, sf_dir, "contents").select(
        "source_id", F.when(F.col("content_type") != "url", day("created_at")).alias("created_day")
    )
    return cat.duplicate_keys(keyed, ["source_id", "created_day"])


@query("P16", with_sql("sources") + "SELECT source_id FROM sources WHERE status <> 'ready'")
def sources_without_status(spark, sf_dir):
    return cat.without_status(standin(spark, sf_dir, "sources"), "ready").select("source_id")


@query(
    "P18",
    """SELECT event_id, CASE WHEN event_type <> 'view' AND k BETWEEN -2 AND 2 AND event_type <> 'error' THEN k END AS score
       FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::INT % 7 - 3 AS k FROM events)""",
)
def valid_scores(spark, sf_dir):
    k = (F.get_json_object("props", "$.k").cast("int") % 7 - 3).cast("string")
    raw = F.when(F.col("event_type") == "error", "bad").otherwise(k)
    return table(spark, sf_dir, "events").select(
        "event_id", cat.valid_score(raw, F.col("event_type") == "view").alias("score")
    )


# ---- J: joins ----


@query(
    "J1",
    """SELECT s.s_suppkey AS supplier_id, n.n_name AS nation, r.r_name AS region FROM supplier s
       LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 0 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def looked_up_dimensions(spark, sf_dir):
    home = F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("home_id")  # a nullable foreign key
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", home)
        .join(table(spark, sf_dir, "nation"), F.col("home_id") == F.col("n_nationkey"), "left")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )


@query(
    "J2",
    with_sql("contents")
    + """SELECT source_id, content_id, status, strftime(created_at, '%Y-%m-%d') AS created_day FROM contents
         QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, content_id DESC) = 1""",
)
def latest_content_per_source(spark, sf_dir):
    newest = cat.latest_child(standin(spark, sf_dir, "contents"), "source_id", ["created_at", "content_id"])
    return newest.select("source_id", "content_id", "status", day("created_at").alias("created_day"))


@query(
    "J3",
    with_sql("contents")
    + "SELECT source_id, content_id FROM contents QUALIFY rank() OVER (PARTITION BY source_id ORDER BY created_at DESC) = 1",
)
def latest_contents_with_ties(spark, sf_dir):
    return cat.latest_children(standin(spark, sf_dir, "contents"), "source_id", "created_at").select("source_id", "content_id")


@query(
    "J4",
    with_sql("contents")
    + """SELECT DISTINCT content_id FROM contents WHERE content_type <> 'url' AND content_id NOT IN
         (SELECT content_id FROM contents WHERE status = 'active')""",
)
def chunks_without_embedding(spark, sf_dir):
    contents = standin(spark, sf_dir, "contents")
    chunks = cat.without_status(contents, "url", "content_type").select("content_id")
    return cat.missing_from(chunks, contents.filter("status = 'active'"), "content_id").distinct()


@query("J5", with_sql("sources", "storages") + "SELECT source_id FROM sources WHERE storage_id IN (SELECT storage_id FROM storages WHERE is_deleted)")
def sources_by_id_set(spark, sf_dir):
    deleted = cat.visible(standin(spark, sf_dir, "storages"), "deleted")
    return standin(spark, sf_dir, "sources").join(deleted, "storage_id", "left_semi").select("source_id")


@query(
    "J11",
    with_sql("contents", "sources", "storages", "corpora")
    + """SELECT c.content_id, concat_ws(' / ', k.name, t.name, s.title, c.content_id) AS trail FROM contents c
         LEFT JOIN sources s USING (source_id) LEFT JOIN storages t USING (storage_id) LEFT JOIN corpora k USING (kb_id)""",
)
def content_trails(spark, sf_dir):
    parts = [standin(spark, sf_dir, n) for n in ("contents", "sources", "storages", "corpora")]
    return cat.ancestry(*parts).select("content_id", "trail")


@query(
    "J13, W5",
    with_sql("contents", "sources")
    + """SELECT s.source_id, coalesce(string_agg(c.content_id, '|' ORDER BY c.content_id), '') AS children FROM sources s
         LEFT JOIN (SELECT source_id, content_id FROM contents QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY content_id) <= 5) c
         USING (source_id) GROUP BY s.source_id""",
)
def sources_with_first_children(spark, sf_dir):
    parents = standin(spark, sf_dir, "sources").select("source_id")
    listed = cat.with_children(parents, standin(spark, sf_dir, "contents"), "source_id", [F.asc("content_id")], F.col("content_id"))
    return listed.select("source_id", F.array_join("children", "|").alias("children"))


@query(
    "W5",
    with_sql("contents")
    + """SELECT source_id, content_id, row_number() OVER (PARTITION BY source_id ORDER BY content_id) AS position FROM contents
         QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY content_id) <= 5""",
)
def first_chunks_per_source(spark, sf_dir):
    first = cat.first_children(standin(spark, sf_dir, "contents"), "source_id", [F.asc("content_id")])
    return first.select("source_id", "content_id", F.col("position").cast("long").alias("position"))


# ---- A: aggregates ----


@query(
    "A1",
    with_sql("corpora", "storages", "owners")
    + """SELECT k.kb_id, count(DISTINCT t.storage_id) AS n_storages, count(DISTINCT o.user_id) AS n_owners FROM corpora k
         LEFT JOIN (SELECT * FROM storages WHERE is_deleted) t USING (kb_id) LEFT JOIN owners o USING (kb_id) GROUP BY k.kb_id""",
)
def child_counts_per_corpus(spark, sf_dir):
    deleted = cat.visible(standin(spark, sf_dir, "storages"), "deleted")
    children = {"n_storages": (deleted, "storage_id"), "n_owners": (standin(spark, sf_dir, "owners"), "user_id")}
    return cat.child_counts(standin(spark, sf_dir, "corpora").select("kb_id"), "kb_id", children)


@query(
    "A2",
    with_sql("storages", "sources", "contents")
    + """SELECT t.storage_id, (SELECT nullif(count(*), 0) FROM sources s WHERE s.storage_id = t.storage_id) AS n_documents,
         e.n AS n_embeddings FROM storages t LEFT JOIN (SELECT s.storage_id, count(*) AS n FROM contents c JOIN sources s USING (source_id)
         WHERE c.status = 'active' AND c.content_type <> 'url' GROUP BY s.storage_id) e USING (storage_id)""",
)
def documents_and_embeddings_per_storage(spark, sf_dir):
    sources = standin(spark, sf_dir, "sources").select("source_id", "storage_id")
    embeddings = standin(spark, sf_dir, "contents").filter("status = 'active'").select(
        F.coalesce(
            F.when(F.col("content_type") == "raw", F.col("source_id")),
            F.when(F.col("content_type") == "cleaned", F.col("source_id")),
        ).alias("source_id")
    )
    per_source = embeddings.groupBy("source_id").agg(F.count("*").alias("n"))
    embedded = per_source.join(sources, "source_id").groupBy("storage_id").agg(F.sum("n").alias("n_embeddings"))
    counted = sources.groupBy("storage_id").agg(F.count("*").alias("n_documents"))
    return standin(spark, sf_dir, "storages").select("storage_id").join(counted, "storage_id", "left").join(
        embedded, "storage_id", "left"
    )


@query(
    "A3",
    with_sql("contents")
    + "SELECT source_id, count(DISTINCT content_id) FILTER (WHERE status = 'active') AS n_embedded FROM contents GROUP BY source_id",
)
def embedded_chunks_per_source(spark, sf_dir):
    embedded = F.when(F.col("status") == "active", F.col("content_id"))
    return standin(spark, sf_dir, "contents").groupBy("source_id").agg(F.countDistinct(embedded).alias("n_embedded"))


@query("A4", with_sql("contents") + "SELECT size_in_tokens, count(*) AS n_chunks FROM contents WHERE status = 'active' GROUP BY 1")
def stored_chunk_size_histogram(spark, sf_dir):
    return cat.size_histogram(standin(spark, sf_dir, "contents")).orderBy("size_in_tokens")


@query(
    "A6",
    with_sql("sources", "contents")
    + "SELECT s.source_id, count(c.source_id) AS n_versions FROM sources s LEFT JOIN contents c USING (source_id) GROUP BY s.source_id",
)
def versions_per_source(spark, sf_dir):
    counted = standin(spark, sf_dir, "contents").groupBy("source_id").agg(F.count("*").alias("n_versions"))
    return standin(spark, sf_dir, "sources").select("source_id").join(counted, "source_id", "left").fillna(0, ["n_versions"])


@query(
    "A7",
    with_sql("sources", "contents")
    + """SELECT storage_id, count(DISTINCT source_id) AS n_sources,
         (count(DISTINCT CASE WHEN content_type = 'raw' THEN content_id END) + count(DISTINCT CASE WHEN content_type = 'cleaned' THEN content_id END))::BIGINT AS n_chunks
         FROM sources LEFT JOIN contents USING (source_id) GROUP BY storage_id""",
)
def chunks_of_both_kinds_per_storage(spark, sf_dir):
    sources = standin(spark, sf_dir, "sources").select("source_id", "storage_id")
    contents = standin(spark, sf_dir, "contents")
    per_kind = [
        contents.filter(F.col("content_type") == kind).groupBy("source_id").agg(F.countDistinct("content_id").alias(kind))
        for kind in ("raw", "cleaned")
    ]
    joined = sources.join(per_kind[0], "source_id", "left").join(per_kind[1], "source_id", "left")
    return joined.groupBy("storage_id").agg(
        F.count("*").alias("n_sources"),
        F.sum(F.coalesce("raw", F.lit(0)) + F.coalesce("cleaned", F.lit(0))).alias("n_chunks"),
    )


@query(
    "A8",
    with_sql("contents")
    + """SELECT source_id, content_type, count(DISTINCT content_id) AS n_chunks, count(DISTINCT CASE WHEN status = 'active' THEN content_id END)
         AS n_embeddings FROM contents GROUP BY ALL""",
)
def chunks_and_embeddings_per_version(spark, sf_dir):
    return standin(spark, sf_dir, "contents").groupBy("source_id", "content_type").agg(
        F.countDistinct("content_id").alias("n_chunks"),
        F.countDistinct(F.when(F.col("status") == "active", F.col("content_id"))).alias("n_embeddings"),
    )


def _tagged(spark, sf_dir):
    tags = F.concat(F.array("lang", "storage_id"), F.split("body", " "))
    return standin(spark, sf_dir, "texts").select("source_id", "storage_id", tags.alias("tags"))


@query(
    "A9",
    with_sql("texts")
    + """SELECT unnest([lang, storage_id, string_split(body, ' ')[1]]) AS tag FROM texts UNION SELECT n_name AS tag FROM nation""",
)
def tag_vocabulary_of_sources(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("tag"))
    return cat.tag_vocabulary(_tagged(spark, sf_dir), 3, known).orderBy(F.desc("tag"))


@query(
    "A10",
    with_sql("texts")
    + """SELECT storage_id, source_id, (len(string_split(body, ' ')) + 2)::BIGINT AS n_tags FROM texts
         QUALIFY row_number() OVER (PARTITION BY storage_id ORDER BY len(string_split(body, ' ')) DESC, source_id) = 1""",
)
def longest_tag_chains(spark, sf_dir):
    return cat.longest_tags(_tagged(spark, sf_dir)).select(
        "storage_id", "source_id", F.size("tags").cast("long").alias("n_tags")
    )


@query("A12, M9", "SELECT user_id AS job_id, event_id AS item_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS outcome FROM events")
def job_outcome_items(spark, sf_dir):
    return cat.job_outcomes(standin(spark, sf_dir, "jobs"), "job_id", "event_id", F.col("event_type") != "error")


@query(
    "A12",
    """SELECT user_id AS job_id, count(*) FILTER (WHERE event_type <> 'error') AS n_success, count(*) FILTER (WHERE event_type = 'error') AS n_failed
       FROM events GROUP BY 1""",
)
def job_outcome_counts(spark, sf_dir):
    items = cat.job_outcomes(standin(spark, sf_dir, "jobs"), "job_id", "event_id", F.col("event_type") != "error")
    return cat.outcome_counts(items, "job_id")


@query(
    "A15",
    """WITH m AS (SELECT md5(lower(text)) AS cluster, source FROM documents),
       s AS (SELECT cluster, count(*) AS cluster_size FROM m GROUP BY 1 HAVING count(*) > 1)
       SELECT cluster, source, count(*) AS n, any_value(cluster_size) AS cluster_size FROM m JOIN s USING (cluster) GROUP BY 1, 2""",
)
def members_per_source_in_clusters(spark, sf_dir):
    members = table(spark, sf_dir, "documents").select(F.md5(F.lower("text")).alias("cluster"), "source")
    return cat.cluster_members(members)


@query("A16", with_sql("sources") + "SELECT count(*) AS n_active, count(*) > 0 AS any_active FROM sources WHERE status = 'active'")
def active_source_guard(spark, sf_dir):
    active = cat.with_status(standin(spark, sf_dir, "sources"), ["active"], fixed.SOURCE_STATUS)
    return active.agg(F.count("*").alias("n_active")).withColumn("any_active", F.col("n_active") > 0)


@query("A17", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def items_per_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.count("*").alias("n"))


# ---- K: order and limit ----


@query(
    "K1",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 3",
)
def latest_reports_of_storage(spark, sf_dir):
    newest = table(spark, sf_dir, "events").filter("user_id = 8").orderBy(F.desc("ts"), F.desc("event_id")).limit(3)
    return newest.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "K2",
    """SELECT conv_id, turn, web, bot, row_number() OVER (ORDER BY turn DESC NULLS FIRST, web ASC NULLS LAST, bot ASC NULLS LAST) AS place
       FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN conv_id END AS web, CASE WHEN role <> 'user' THEN conv_id END AS bot FROM conversations)""",
)
def ordered_messages(spark, sf_dir):
    mine = F.col("role") == "user"
    messages = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(mine, F.col("conv_id")).alias("web"), F.when(~mine, F.col("conv_id")).alias("bot")
    )
    order = [F.desc_nulls_first("turn"), F.asc_nulls_last("web"), F.asc_nulls_last("bot")]
    return cat.numbered(messages, order, "place")


# ---- U: set operations ----


@query("U1", "SELECT c_custkey AS storage_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def catalogue_minus_incoming(spark, sf_dir):
    seen = standin(spark, sf_dir, "sources").filter("status = 'ready'")
    return cat.missing_from(standin(spark, sf_dir, "storages").select("storage_id"), seen, "storage_id")


@query(
    "U2",
    with_sql("contents")
    + "SELECT source_id FROM contents WHERE content_type = 'raw' UNION SELECT source_id FROM contents WHERE content_type = 'cleaned'",
)
def sources_by_either_path(spark, sf_dir):
    contents = standin(spark, sf_dir, "contents")
    raw, cleaned = (contents.filter(F.col("content_type") == k).select("source_id") for k in ("raw", "cleaned"))
    return raw.union(cleaned).distinct()


@query(
    "U3",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
       SELECT k AS storage_id, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
       UNION ALL SELECT k, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def added_and_removed_members(spark, sf_dir):
    sources = standin(spark, sf_dir, "sources")
    old = sources.filter("status = 'active'").select("storage_id").distinct()
    new = sources.filter("status = 'ready'").select("storage_id").distinct()
    return cat.set_changes(old, new, "storage_id")
