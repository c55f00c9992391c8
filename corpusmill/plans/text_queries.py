"""Text, list, JSON and date functions over whole tables."""

from pyspark.sql import functions as F

from corpusmill.functions import fixed, meta, text
from corpusmill.plans.registry import lit, query, table

# ---- stand-ins: marked-up variants of the document texts, built alike on both sides ----

MESSY_SQL = (
    "replace(text, '. ', '.  ' || chr(160) || chr(10) || ' ' || chr(10))"
    " || chr(8203) || chr(7) || chr(10) || '  '"
)
MARKED_SQL = (
    "'# ' || source || chr(10) || replace(text, chr(10), chr(10) || '## ' || lang || chr(10))"
    " || chr(10) || '- item' || chr(10) || '---' || chr(10) || '**bold** `code` [site](http://' || source"
    " || '.example.com/' || doc_id || ') https://example.com/' || doc_id || ' ```x = 1``` end'"
)


def messy():
    filler = "replace(text, '. ', concat('.  ', chr(160), '\n \n'))"
    return F.concat(F.expr(filler), F.lit("​\u0007\n  "))


def marked():
    return F.concat(
        F.lit("# "), F.col("source"), F.lit("\n"),
        F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n## "), F.col("lang"), F.lit("\n"))),
        F.lit("\n- item\n---\n**bold** `code` [site](http://"), F.col("source"),
        F.lit(".example.com/"), F.col("doc_id"), F.lit(") https://example.com/"),
        F.col("doc_id"), F.lit(" ```x = 1``` end"),
    )


def sub(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"


def strip_sql(expr: str) -> str:
    return sub(expr, rf"^{text.BLANK}+|{text.BLANK}+$")


def count_sql(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(pattern)}))"


# ---- T1-T7 ----

# The twins of the text functions are written on their own, not from the patterns of the functions.
_seen = f"regexp_replace({MESSY_SQL}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{200B}}\\x{{2028}}\\x{{2029}}\\x{{FEFF}}]', '', 'g')"
_lines = f"string_split(regexp_replace(replace({_seen}, chr(160), ' '), '[ \\t]+', ' ', 'g'), chr(10))"
NORMALIZED_SQL = f"array_to_string(list_filter({_lines}, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''), chr(10))"


@query("T1, H14", f"SELECT doc_id, {NORMALIZED_SQL} AS clean FROM documents")
def normalized_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(messy()).alias("clean"))


@query(
    "T2, H14",
    f"SELECT doc_id, {sub('replace(text, chr(46), chr(46) || chr(128512) || chr(8482) || chr(9996))', text.EMOJI_PATTERN)}"
    " AS clean FROM documents",
)
def texts_without_emoji(spark, sf_dir):
    decorated = F.replace(F.col("text"), F.lit("."), F.lit(".\U0001F600™✌"))
    return table(spark, sf_dir, "documents").select("doc_id", text.remove_emoji(decorated).alias("clean"))


_rows = f"string_split({MARKED_SQL}, chr(10))"
_kept = f"list_filter({_rows}, lambda x: NOT regexp_matches(x || chr(10), '^(#+|[*]|-|[0-9]+[.])[ \\t\\n\\r\\f\\v]'))"
_t = f"array_to_string({_kept}, chr(10))"
for _pattern, _to in [("(--|__|[*][*])[-_*]*\\n?", ""), ("[*]([^*]+)[*]", r"\1"), ("`([^`]+)`", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), ("https?://[^ \\n\\t]+", "")]:
    _t = sub(_t, _pattern, _to)


@query("T3", f"SELECT doc_id, {_t} AS clean FROM documents")
def texts_without_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_markdown(marked()).alias("clean"))


CLEAN_SQL = "array_to_string(regexp_extract_all(text, '[a-zA-Zа-яА-ЯёЁ-]+'), ' ')"
JUNK_SQL = "(length(text) - length(array_to_string(regexp_extract_all(text, '[a-zA-Zа-яА-ЯёЁ -]+'), '')))"


@query(
    "T4",
    f"SELECT doc_id, {CLEAN_SQL} AS clean,"
    f" round(CASE WHEN length(text) = 0 THEN 0.0 ELSE {JUNK_SQL}::DOUBLE / length(text) END, 6)"
    " AS junk FROM documents",
)
def letters_only_texts(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.clean_text(c).alias("clean"), F.round(text.junk_ratio(c), 6).alias("junk")
    )


@query("T6", f"SELECT conv_id, turn, {strip_sql(sub('lower(text)', text.NON_WORD))} AS question FROM conversations")
def cleaned_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.clean_question(F.col("text")).alias("question")
    )


DEDUPE_SQL = f"coalesce({sub(sub(strip_sql('lower(text)'), text.NON_WORD), text.BLANK + '+', ' ')}, '')"


@query("T7", f"SELECT doc_id, {DEDUPE_SQL} AS dedupe_key FROM documents")
def dedupe_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.dedupe_key(F.col("text")).alias("dedupe_key"))


# ---- T9-T17 ----


@query(
    "T9",
    """SELECT doc_id,
         CASE WHEN len(list_filter([lang, 'docs', split_part(text, ' ', 1)], lambda x: x <> source)) > 0
              THEN 'Категории: ' || array_to_string(list_filter([lang, 'docs', split_part(text, ' ', 1)], lambda x: x <> source), ', ') || '. '
              ELSE '' END || 'Заголовок: ' || source || '. ' AS header
       FROM documents""",
)
def chunk_headers(spark, sf_dir):
    tags = F.array(F.lit("root"), F.col("lang"), F.lit("docs"), F.col("source"), F.split_part("text", F.lit(" "), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", meta.chunk_header(F.col("source"), tags).alias("header"))


@query(
    "T10, T11",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS who,
         event_type AS first_tag, 2::BIGINT AS n_tags, 7::BIGINT AS n_all, 6::BIGINT AS n_kept, 2 + (user_id <> 0)::BIGINT + (user_id % 4 <> 0)::BIGINT + (json_extract(props, '$.k')::BIGINT <> 0)::BIGINT AS n_true
       FROM events""",
)
def flattened_event_json(spark, sf_dir):
    nested = F.to_json(
        F.named_struct(
            F.lit("props"), F.from_json("props", "k long"),
            F.lit("user"), F.named_struct(F.lit("id"), F.col("user_id"), F.lit("note"), F.lit(""), F.lit("left"), F.col("user_id") % 4, F.lit("off"), F.lit(False)),
            F.lit("tags"), F.array(F.col("event_type"), F.lit("seen")),
        )
    )
    # note '' stays in the plain form and goes in the second; 0 and false go in the third
    df = table(spark, sf_dir, "events").select("event_id", "user_id", meta.flat_json_forms(nested).alias("f"))
    leaves = F.col("f.without_empty")
    return df.select(
        "event_id",
        leaves["props_k"].alias("k"),
        leaves["user_id"].alias("who"),
        leaves["tags_0"].alias("first_tag"),
        F.size(F.map_filter(leaves, lambda k, _: k.startswith("tags_"))).cast("long").alias("n_tags"),
        F.size("f.everything").cast("long").alias("n_all"),
        F.size("f.without_empty").cast("long").alias("n_kept"),
        F.size("f.without_false").cast("long").alias("n_true"),
    )


@query(
    "T12",
    """SELECT doc_id, text || ' see plan ' || doc_id || ' or file ' || doc_id AS body,
         'files__images__0__1=plan ' || doc_id || ' http://img.example.com/' || doc_id || '.png;' ||
         'files__images__1__1=file ' || doc_id || ' http://doc.example.com/' || doc_id || '.pdf' AS fields
       FROM documents""",
)
def texts_with_inlined_files(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    picture = F.concat(F.lit("http://img.example.com/"), number, F.lit(".png"))
    document = F.concat(F.lit("http://doc.example.com/"), number, F.lit(".pdf"))
    absent = F.concat(F.lit("http://none.example.com/"), number, F.lit(".doc"))
    body = F.concat(F.col("text"), F.lit(" see ![plan "), number, F.lit("]("), picture, F.lit(") or "), document)
    files = F.array(
        F.struct(F.lit("").alias("text"), picture.alias("url")),
        F.struct(F.concat(F.lit("file "), number).alias("text"), document.alias("url")),
        F.struct(F.lit("absent").alias("text"), absent.alias("url")),
    )
    df = table(spark, sf_dir, "documents").select("doc_id", meta.inline_files(body, files, "files__images").alias("r"))
    pairs = F.transform(F.map_entries("r.metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.select("doc_id", F.col("r.text").alias("body"), F.array_join(pairs, ";").alias("fields"))


_LINKS = "[lang || ' http://a.example.com/' || doc_id, source || ' http://b.example.com/' || doc_id]"


def _example_links():
    return F.array(
        F.struct(F.col("lang").alias("text"), F.concat(F.lit("http://a.example.com/"), F.col("doc_id")).alias("url")),
        F.struct(F.col("source").alias("text"), F.concat(F.lit("http://b.example.com/"), F.col("doc_id")).alias("url")),
    )


@query(
    "T13",
    f"SELECT doc_id, 'external_links__' || (i - 1) AS field, {_LINKS}[i] AS value"
    " FROM documents, unnest([1, 2]) AS u(i)",
)
def link_metadata_fields(spark, sf_dir):
    fields = meta.link_fields(_example_links(), "external_links")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(fields).alias("field", "value"))


@query(
    "T14, T15",
    f"""SELECT doc_id, text || chr(10) || chr(10) || {lit(fixed.LINKS_HEADING)} || chr(10) || '- ' || {_LINKS}[1]
           || chr(10) || '- ' || {_LINKS}[2] ||
           CASE WHEN lang <> 'fr' THEN {lit(fixed.SOURCE_LINE)} || 'http://' || source ELSE '' END AS enriched
       FROM documents""",
)
def enriched_texts(spark, sf_dir):
    metadata = meta.overlay(
        F.create_map(F.lit("internal_links__0"), F.lit("skip")), meta.link_fields(_example_links(), "external_links")
    )
    url = F.when(F.col("lang") != "fr", F.concat(F.lit("http://"), F.col("source"))).otherwise(F.lit("ftp://x"))
    body = meta.append_source_url(meta.append_materials(F.col("text"), metadata), url)
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("enriched"))


@query(
    "T16, U5",
    f"""WITH p AS (SELECT doc_id, unnest(string_split(replace(text, ' ', '", '), ',')) AS s FROM documents)
       SELECT doc_id, count(*) AS n_items, count(DISTINCT s) AS n_unique, min(s) AS first_item, max(s) AS last_item
       FROM (SELECT doc_id, trim({strip_sql('s')}, '"') AS s FROM p) WHERE s <> '' GROUP BY doc_id""",
)
def parsed_comma_lists(spark, sf_dir):
    quoted = F.replace(F.col("text"), F.lit(" "), F.lit('", '))
    df = table(spark, sf_dir, "documents").select("doc_id", meta.comma_list(quoted).alias("items"))
    unique = F.array_distinct("items")
    return df.filter(F.size("items") > 0).select(
        "doc_id",
        F.size("items").cast("long").alias("n_items"),
        F.size(unique).cast("long").alias("n_unique"),
        F.array_min("items").alias("first_item"),
        F.array_max("items").alias("last_item"),
    )


@query(
    "T17",
    f"""SELECT conv_id, turn,
         CASE WHEN role = 'user' THEN 'expert|' || role
              ELSE array_to_string(list_filter(list_transform(string_split(text, ','), lambda s: {strip_sql('s')}), lambda s: s <> ''), '|')
         END AS specialists
       FROM conversations""",
)
def router_outputs(spark, sf_dir):
    answer = F.when(F.col("role") == "user", F.concat(F.lit("['expert', '"), F.col("role"), F.lit("']"))).otherwise(
        F.col("text")
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(meta.router_list(answer), "|").alias("specialists")
    )


@query(
    "U5",
    f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(
           string_split(replace(replace(text, chr(10), ','), '"', ''), ','), lambda s: {strip_sql('s')}), lambda s: s <> ''))), '|') AS parts
       FROM conversations""",
)
def clean_unique_parts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(meta.clean_unique(F.array("text")), "|").alias("parts")
    )


@query(
    "U4",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'a|click|b' ELSE 'a|click|' || event_type || '|b' END AS merged
       FROM events""",
)
def merged_unique_lists(spark, sf_dir):
    merged = meta.merge_unique(
        F.array(F.lit("a"), F.lit("click"), F.lit("a")), F.array(F.col("event_type"), F.lit("b"), F.lit("a"))
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(merged, "|").alias("merged"))


# ---- T19-T30 ----


@query(
    "T19",
    r"""WITH c AS (SELECT event_id, CASE event_type WHEN 'error' THEN 0.0 WHEN 'click' THEN floor(value) / 1e7
                     ELSE floor(value) / 1e4 END AS cost FROM events)
       SELECT event_id, CASE WHEN cost = 0 THEN '0' WHEN cost < 0.0001 THEN printf('%.2e', cost)
         ELSE regexp_replace(printf('%.6f', cost), '\.?0+$', '') END AS shown FROM c""",
)
def displayed_costs(spark, sf_dir):
    whole = F.floor("value")
    cost = (
        F.when(F.col("event_type") == "error", F.lit(0.0))
        .when(F.col("event_type") == "click", whole / F.lit(1e7))
        .otherwise(whole / F.lit(1e4))
    )
    return table(spark, sf_dir, "events").select("event_id", text.cost_text(cost).alias("shown"))


_WRAPPED = "'```json' || chr(10) || '<think>' || text || '</think>' || chr(10) || chr(10) || role || chr(10) || '```'"


@query(
    "T20",
    "SELECT conv_id, turn, "
    + sub(sub(strip_sql(_WRAPPED), r"^```(?:json)?\n|```$"), r"(?s)<think>.*?</think>\n\n")
    + " AS answer FROM conversations",
)
def unwrapped_model_texts(spark, sf_dir):
    wrapped = F.concat(F.lit("```json\n<think>"), F.col("text"), F.lit("</think>\n\n"), F.col("role"), F.lit("\n```"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.strip_thinking(text.strip_code_fence(wrapped)).alias("answer")
    )


@query(
    "T21",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS iso FROM orders""",
)
def iso_dates(spark, sf_dir):
    typed = (
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd.MM.yyyy"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "'32.13.'yyyy"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.iso_date(typed).alias("iso"))


_PATHS = "'/files/' || source || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'PDF' WHEN 'fr' THEN 'tar.gz' WHEN 'de' THEN 'JPeG' ELSE '' END"


@query(
    "T22",
    f"""SELECT doc_id, lower(regexp_extract({_PATHS}, '[^/\\\\]\\.([^./\\\\]+)$', 1)) AS extension,
         lang = 'de' AS picture FROM documents""",
)
def file_extensions(spark, sf_dir):
    ending = F.when(F.col("lang") == "en", "PDF").when(F.col("lang") == "fr", "tar.gz").when(
        F.col("lang") == "de", "JPeG").otherwise("")
    path = F.concat(F.lit("/files/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), ending)
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.file_extension(path).alias("extension"), text.is_image(path).alias("picture")
    )


TRIGRAMS_SQL = r"""list_distinct(flatten(list_transform(
    list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(
    "T23, J6",
    f"""WITH t AS (SELECT conv_id, turn, role, {TRIGRAMS_SQL.format('text')} AS g FROM conversations),
         p AS (SELECT q.conv_id, q.turn, q.g AS a, r.g AS b FROM t q JOIN t r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1
               WHERE q.role = 'user' AND r.role = 'assistant')
       SELECT conv_id, turn, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity
       FROM p""",
)
def question_answer_similarity(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    asked = talk.filter("role = 'user'").select("conv_id", "turn", text.trigrams(F.col("text")).alias("a"))
    told = talk.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), text.trigrams(F.col("text")).alias("b")
    )
    return asked.join(told, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.set_similarity(F.col("a"), F.col("b")), 6).alias("similarity")
    )


@query("T24", f"SELECT doc_id, {count_sql('text', text.TOKEN_PATTERN)}::BIGINT AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query("T25", "SELECT conv_id, turn, replace('http://old.host/' || text, 'http://old.host', 'https://new.host') AS answer FROM conversations")
def answers_on_new_host(spark, sf_dir):
    answer = F.replace(F.concat(F.lit("http://old.host/"), "text"), F.lit("http://old.host"), F.lit("https://new.host"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))


@query(
    "T27",
    f"""WITH m AS (SELECT doc_id, {count_sql(MARKED_SQL, text.HEADER_LINE)} AS h, {count_sql(MARKED_SQL, text.LIST_LINE)} AS l FROM documents)
       SELECT doc_id, CASE WHEN h >= 3 OR (h >= 1 AND l >= 2) THEN 'markdown' ELSE 'recursive' END AS strategy FROM m""",
)
def split_strategies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.split_strategy(marked()).alias("strategy"))


@query(
    "T28",
    """SELECT doc_id, '# Words: ' || CASE WHEN lang = 'en' THEN source || ', ' || lang ELSE 'не обнаружено' END
         || chr(10) || '# Place: ' || source AS report FROM documents""",
)
def stage_reports(spark, sf_dir):
    words = F.when(F.col("lang") == "en", F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    report = meta.stage_report({"w": words, "p": F.array("source")}, {"w": "Words", "p": "Place"})
    return table(spark, sf_dir, "documents").select("doc_id", report.alias("report"))


@query(
    "T29",
    """SELECT event_id, 'new' AS a, event_type AS b, user_id::VARCHAR AS c FROM events""",
)
def merged_maps(spark, sf_dir):
    merged = meta.overlay(
        F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("event_type")),
        F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.col("user_id").cast("string")),
    )
    df = table(spark, sf_dir, "events").select("event_id", merged.alias("m"))
    return df.select("event_id", *[F.col("m")[k].alias(k) for k in "abc"])


@query(
    "T30",
    f"""SELECT doc_id, regexp_matches(text, {lit(text.MARKDOWN_SIGN)}) AS plain_is_markdown,
         regexp_matches({MARKED_SQL}, {lit(text.MARKDOWN_SIGN)}) AS marked_is_markdown,
         {sub(MARKED_SQL, chr(92) + '[([^' + chr(92) + ']]+)' + chr(92) + ']' + chr(92) + '((https?://[^' + chr(92) + ')]+)' + chr(92) + ')', '*[' + chr(92) + '1](' + chr(92) + '2)*')} AS shown
       FROM documents""",
)
def markdown_signs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.is_markdown(F.col("text")).alias("plain_is_markdown"),
        text.is_markdown(marked()).alias("marked_is_markdown"),
        text.emphasize_links(marked()).alias("shown"),
    )


@query("S2", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def text_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
