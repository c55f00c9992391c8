"""Chat log analytics: question and answer pairs, history windows, cost, tests, accumulated facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.operators.catalog import exact_quantile, latest_child, valid_score

# ---- questions and answers ----


def question_answers(messages: DataFrame) -> DataFrame:
    """Questions with their answer, NULL when there is none. Both sides join on a unique id."""
    asked = messages.filter("is_user").select(
        F.col("message_id").alias("question_id"), "session_id", "created_at", F.col("text").alias("question")
    )
    told = messages.filter("NOT is_user AND answer_for IS NOT NULL").select(
        F.col("answer_for").alias("question_id"),
        F.col("message_id").alias("answer_id"),
        F.col("text").alias("answer"),
        "extended_log",
        "score",
    )
    return asked.join(told, "question_id", "left")


def real_questions(messages: DataFrame) -> DataFrame:
    """Answered user questions that were no test run."""
    real = messages.filter(F.col("answer_for").isNotNull() & F.get_json_object("extended_log", "$.test").isNull())
    answered = real.select(F.col("answer_for").alias("message_id"))
    return messages.filter("is_user").join(answered, "message_id", "left_semi")


def recent_history(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last n questions of every session with their answers, oldest first, in one array."""
    newest_first = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    last = messages.filter("is_user").withColumn("_r", F.row_number().over(newest_first)).filter(F.col("_r") <= n)
    told = messages.filter("answer_for IS NOT NULL").select(
        F.col("answer_for").alias("message_id"), F.col("text").alias("answer")
    )
    turn = F.struct((-F.col("_r")).alias("at"), F.col("text").alias("question"), "answer")
    return (
        last.join(told, "message_id", "left")
        .groupBy("session_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )


def transcript(turns: Column) -> Column:
    """'user: ... / assistant: ...' lines of a history; an unanswered question has no answer line."""
    lines = F.transform(
        turns,
        lambda t: F.concat_ws(
            "\n", F.concat(F.lit("user: "), t["question"]), F.concat(F.lit("assistant: "), t["answer"])
        ),
    )
    return F.array_join(lines, "\n")


def last_pair(messages: DataFrame) -> DataFrame:
    """Latest client and latest manager message of every session, as an aggregate."""
    order = F.struct("created_at", "message_id")
    return messages.groupBy("session_id").agg(
        F.max_by(F.when(F.col("is_user"), F.col("text")), F.when(F.col("is_user"), order)).alias("last_client"),
        F.max_by(F.when(~F.col("is_user"), F.col("text")), F.when(~F.col("is_user"), order)).alias("last_manager"),
    )


def chat_report(messages: DataFrame) -> DataFrame:
    """Question rows with answer, model, retriever scheme and processing time."""
    log = F.col("extended_log")
    return question_answers(messages).withColumns(
        {
            "llm": F.get_json_object(log, "$.llm"),
            "retriever_scheme": F.get_json_object(log, "$.retriever_scheme"),
            "processing_time": F.get_json_object(log, "$.processing_time").cast("double"),
        }
    )


# ---- cost ----


def _prices() -> Column:
    """model -> struct<input, cached, output> as a literal map: 26 fixed entries, no join."""
    rows = []
    for model, prices in fixed.TOKEN_PRICES.items():
        named = [F.lit(p).cast("double").alias(n) for p, n in zip(prices, ("input", "cached", "output"))]
        rows += [F.lit(model), F.struct(*named)]
    return F.create_map(*rows)


def model_name(c: Column) -> Column:
    """Model without its date suffix."""
    return F.regexp_replace(c, r"-\d{4}-\d{2}-\d{2}$", "")


def token_cost(model: Column, prompt_tokens: Column, answer_tokens: Column, cached: bool = False) -> Column:
    """struct<prompt, answer, total> in USD; an unknown model has the penalty price, 'n/a' is free.

    A price the provider does not offer gives NULL.
    """
    name = model_name(model)
    price = F.try_element_at(_prices(), name)
    unknown = F.lit(fixed.UNKNOWN_MODEL_PRICE)
    free = name == "n/a"
    per_prompt = F.when(free, 0.0).when(price.isNull(), unknown).otherwise(price["cached" if cached else "input"])
    per_answer = F.when(free, 0.0).when(price.isNull(), unknown).otherwise(price["output"])
    prompt, answer = per_prompt * prompt_tokens / 1e6, per_answer * answer_tokens / 1e6
    return F.struct(prompt.alias("prompt"), answer.alias("answer"), (prompt + answer).alias("total"))


def cost_rollup(usage: DataFrame, by: list[str]) -> DataFrame:
    """Totals of cost and tokens per group of (stage, model, prompt_tokens, answer_tokens) rows.

    Costs are added up as decimals, so the total does not depend on the order of the rows.
    """
    cost = token_cost(F.col("model"), F.col("prompt_tokens"), F.col("answer_tokens"))
    priced = usage.withColumn("cost", cost["total"].cast("decimal(28,8)"))
    return priced.groupBy(*by).agg(
        F.sum("cost").cast("double").alias("cost"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("answer_tokens").alias("answer_tokens"),
    )


# ---- evaluation ----


def sample_sources(sources: DataFrame, n: int, seed: int) -> DataFrame:
    """n random ACTIVE sources per storage, the same ones for the same seed."""
    active = sources.filter(F.col("status") == "active")
    order = F.md5(F.concat_ws("-", F.col("source_id").cast("string"), F.lit(str(seed))))
    drawn = active.withColumn("_r", F.row_number().over(Window.partitionBy("storage_id").orderBy(order, "source_id")))
    return drawn.filter(F.col("_r") <= n).drop("_r")


def sample_shortage(storages: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Storages that cannot give n ACTIVE sources."""
    found = sources.filter(F.col("status") == "active").groupBy("storage_id").agg(F.count("*").alias("n_active"))
    return storages.select("storage_id").join(found, "storage_id", "left").fillna(0, ["n_active"]).filter(
        F.col("n_active") < n
    )


def checked_sample(storages: DataFrame, sources: DataFrame, n: int, seed: int) -> DataFrame:
    """The sample, or an error naming some storages with too few sources."""
    short = sample_shortage(storages, sources, n).limit(5).collect()
    if short:
        raise ValueError(f"fewer than {n} active sources in storages {[r['storage_id'] for r in short]}")
    return sample_sources(sources, n, seed)


def test_texts(sources: DataFrame, contents: DataFrame) -> DataFrame:
    """Text to test on of every ACTIVE source: the whole newest body, or a file card."""
    sources = sources.filter(F.col("status") == "active")
    newest = latest_child(contents.select("source_id", "content_id", "created_at", "body"), "source_id", ["created_at", "content_id"])
    card = F.concat(F.lit("Документ: "), "file_url", F.lit(". Описание: "), F.coalesce("description", F.lit("")))
    text = F.when(F.col("output_format") == "f", card).otherwise(F.col("body"))
    return sources.join(newest.select("source_id", "body"), "source_id").select("source_id", text.alias("test_text"))


def evaluations(records: DataFrame, column: str = "record") -> DataFrame:
    """Scores of evaluation records; a record that is no JSON object is left out."""
    schema = "answer_score string, prompt_score string, answer_resume string, prompt_resume string"
    parsed = records.withColumn("r", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    is_object = F.get_json_object(column, "$").startswith("{")
    return parsed.filter(is_object).select(
        *[c for c in records.columns if c != column],
        valid_score(F.col("r.answer_score"), F.lit(False)).alias("answer_score"),
        valid_score(F.col("r.prompt_score"), F.lit(False)).alias("prompt_score"),
        "r.answer_resume",
        "r.prompt_resume",
    )


def test_runs(messages: DataFrame) -> DataFrame:
    """Answered test questions per kind, model and scheme: number, latency, score."""
    log = F.col("extended_log")
    runs = messages.filter("answer_for IS NOT NULL").select(
        F.get_json_object(log, "$.test").alias("test"),
        F.get_json_object(log, "$.llm").alias("llm"),
        F.get_json_object(log, "$.retriever_scheme").alias("scheme"),
        F.get_json_object(log, "$.processing_time").cast("double").alias("seconds"),
        valid_score(F.col("score").cast("string"), F.lit(False)).alias("score"),
    )
    runs = runs.filter("test IS NOT NULL")
    kinds = ["test", "llm", "scheme"]
    means = runs.groupBy(*kinds).agg(F.count("*").alias("n_runs"), F.avg("seconds").alias("avg_seconds"), F.avg("score").alias("avg_score"))
    late = exact_quantile(runs, kinds, "seconds", 0.95, "p95_seconds")
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"l.{k}")) for k in kinds]
    both = means.alias("m").join(late.alias("l"), same, "left")
    return both.select(*[f"m.{k}" for k in kinds], "n_runs", "avg_seconds", "p95_seconds", "avg_score")


def enriched_tests(tests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tests with the number of chunks of their URL and how many of the retrieved ones came from it."""
    counted = chunks.groupBy("url").agg(F.count("*").alias("chunks_counter"))
    used = F.size(F.filter("ai_documents", lambda u: u == F.col("url")))
    return tests.join(counted, "url", "left").withColumn("used_chunks", used)


# ---- accumulated facts ----


def fact_items(facts: DataFrame) -> DataFrame:
    """Distinct list facts of every session in order of first appearance, one row per value.

    ``facts``: session_id, turn, name, value array<string>. A session may be of any size: values are
    pre-aggregated and never gathered.
    """
    items = facts.select("session_id", "turn", "name", F.posexplode("value").alias("pos", "item"))
    first = F.min(F.struct("turn", "pos")).alias("first")
    return items.filter("item <> ''").groupBy("session_id", "name", "item").agg(first)


def fact_lists(facts: DataFrame) -> DataFrame:
    """``fact_items`` as ordered lists, one per session and name at any length.

    The list is what is asked for, so it has to fit into one cell; ``fact_items`` is the form without that limit.
    """
    listed = F.array_sort(F.collect_list(F.struct("first", "item")))
    return fact_items(facts).groupBy("session_id", "name").agg(F.transform(listed, lambda x: x["item"]).alias("items"))


def fact_texts(facts: DataFrame) -> DataFrame:
    """Text facts joined by '. ', one text per session at any length.

    Every text after a session's first one loses its closing dots and spaces.
    """
    said = facts.filter(F.col("text") != "")
    first = said.groupBy("session_id").agg(F.min("turn").alias("first_turn"))
    trimmed = F.regexp_replace("text", r"[. ]+$", "")
    piece = F.when(F.col("turn") == F.col("first_turn"), F.col("text")).otherwise(trimmed)
    parts = said.join(first, "session_id")
    ordered = F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["piece"]), ". ")
    return parts.groupBy("session_id").agg(joined.alias("text"))
