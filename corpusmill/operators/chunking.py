"""Documents to chunks.

A splitter adds ``pieces`` array<struct<page_content, metadata map, n_tokens>> to a table holding
``body`` and ``metadata``; the jobs explode that array. One document is one row from start to end, so a
chunking job never shuffles on a key.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import meta
from corpusmill.functions.splitting import LEGAL_SEPARATORS, recursive_split
from corpusmill.functions.text import split_strategy, strip, token_count

# ---- building blocks, all Column -> Column ----


def fixed_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before.

    A window that would only repeat the end of the previous one is not made. The text is cut into steps once, and
    neighbouring steps are joined, so a long text is not read again for every window.
    """
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0))
    steps = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"))

    def windows(pieces: Column) -> Column:
        joined = lambda i: F.array_join(F.slice(pieces, i + 1, F.lit(-(-size // step))), "")
        return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.left(joined(i), F.lit(size)))

    return F.transform(F.array(steps), windows)[0]  # binds the steps, so they are cut once


HEADED = "array<struct<text:string,path:array<struct<level:int,name:string>>>>"
MARK = "\u0001"


def header_sections(text: Column, levels: list[int]) -> Column:
    """Sections of a Markdown text at the given heading levels, headings kept.

    Gives array<struct<text, path array<struct<level,name>>>>. Headings inside code fences do not count,
    a heading without text of its own stays with a deeper section that follows, and neighbours under the
    same headings are one section.
    """
    marks = "|".join("#" * n for n in sorted(levels, reverse=True))
    heading = rf"(?m)^[ \t]*((?:{marks})(?: .*)?)$"
    fenced = r"(?s:(^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)|\z)))"
    marked = F.regexp_replace(text, rf"(?md){fenced}|{heading[4:]}", f"$1{MARK}$2")

    def tidy(t: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n"), r"\n{2,}", "  \n"))

    def parsed(body: Column) -> Column:
        level = F.length(F.regexp_extract(body, r"^(#+)( |\n|$)", 1))
        name = strip(F.regexp_extract(body, r"^#+(?: ([^\n]*))?", 1))
        return F.struct(
            body.alias("text"), F.when(level.isin([int(n) for n in levels]), level).alias("level"), name.alias("name")
        )

    bodies = F.filter(F.transform(F.split(marked, MARK), tidy), lambda b: b != "")
    pieces = F.transform(bodies, parsed)

    def step(acc: Column, piece: Column) -> Column:
        above = F.filter(acc["path"], lambda p: p["level"] < piece["level"])
        path = F.when(
            piece["level"].isNotNull(),
            F.array_append(above, F.struct(piece["level"].alias("level"), piece["name"].alias("name"))),
        ).otherwise(acc["path"])
        done = acc["done"]
        last = F.try_element_at(done, F.lit(-1))
        bare = F.regexp_extract(last["text"], r"([^\n]*)$", 1).startswith("#") & (F.size(last["path"]) < F.size(path))
        joins = F.coalesce((last["path"] == path) | bare, F.lit(False))
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        joined = F.concat(last["text"], F.lit("  \n"), piece["text"])
        section = F.struct(F.when(joins, joined).otherwise(piece["text"]).alias("text"), path.alias("path"))
        return F.struct(F.array_append(F.when(joins, shorter).otherwise(done), section).alias("done"), path.alias("path"))

    start = F.struct(
        F.array().cast(HEADED).alias("done"), F.array().cast("array<struct<level:int,name:string>>").alias("path")
    )
    return F.aggregate(pieces, start, step, lambda acc: acc["done"])


def merge_short_tail(chunks: Column, size: int, min_tail: int, min_overlap: int) -> Column:
    """Glue a last chunk shorter than ``min_tail`` percent of the size to the one before.

    Their longest common seam of at least ``min_overlap`` characters is written once.
    """

    def tail(pair: Column) -> Column:
        before, last = pair["before"]["text"], pair["last"]["text"]
        longest = F.least(F.length(before), F.length(last))
        seams = F.filter(
            F.sequence(F.lit(min_overlap), F.greatest(longest, F.lit(min_overlap))),
            lambda k: (k <= longest) & (F.right(before, k) == F.left(last, k)),
        )
        text = F.concat(before, F.substr(last, F.coalesce(F.array_max(seams), F.lit(0)) + 1))
        return F.struct(text.alias("text"), token_count(text).alias("n_tokens"))

    def merged(c: Column) -> Column:
        last = F.try_element_at(c, F.lit(-1))
        short = (F.size(c) >= 2) & (last["n_tokens"] < int(size * min_tail / 100))
        pair = F.struct(F.try_element_at(c, F.lit(-2)).alias("before"), last.alias("last"))
        head = F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0)))
        return F.when(short, F.concat(head, F.transform(F.array(pair), tail))).otherwise(c)

    return F.transform(F.array(chunks), merged)[0]


def merge_small(chunks: Column, smallest: int, largest: int, count: Callable[[Column], Column] = token_count) -> Column:
    """Join neighbouring chunks below ``smallest`` while the joined one stays within ``largest``.

    ``chunks`` is array<struct<text,n_tokens>>; a chunk of normal size closes the one being gathered.
    """

    def step(acc: Column, c: Column) -> Column:
        open_, done = acc["open"], acc["done"]
        text = F.concat(open_["text"], F.lit("\n\n"), c["text"])
        joined = F.struct(text.alias("text"), count(text).alias("n_tokens"))
        small = c["n_tokens"] < smallest
        fits = small & open_.isNotNull() & (joined["n_tokens"] <= largest)
        flushed = F.when(open_.isNull() | fits, done).otherwise(F.array_append(done, open_))
        return F.struct(
            F.when(small, flushed).otherwise(F.array_append(flushed, c)).alias("done"),
            F.when(fits, joined).when(small, c).alias("open"),
        )

    item = "struct<text:string,n_tokens:int>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("open"))
    return F.aggregate(
        chunks,
        start,
        step,
        lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])),
    )


# Letters that count as the script of a chunk, and left-over mark-up.
CYRILLIC = "[А-Яа-яё]"
ARTIFACTS = r"#{1,6}|\*\*|\(\)|\[\]"


def with_quality(chunk: Column, smallest: int, largest: int, letters: str = CYRILLIC) -> Column:
    """Size, ratio, script share and leftover mark-up of a chunk struct<text,n_tokens>."""
    text, n = chunk["text"], chunk["n_tokens"]
    chars = F.length(text)
    ratio = F.coalesce(F.try_divide(chars, n), F.lit(0.0))
    share = F.coalesce(F.try_divide(F.regexp_count(text, F.lit(letters)), chars) * 100, F.lit(0.0))
    counted = F.array(F.struct(share.alias("share"), F.regexp_count(text, F.lit(ARTIFACTS)).alias("artifacts")))

    def measured(m: Column) -> Column:
        return F.struct(
            text.alias("text"),
            n.alias("n_tokens"),
            chars.alias("n_chars"),
            ratio.alias("char_token_ratio"),
            n.between(smallest, largest).alias("in_target_range"),
            ratio.between(1.8, 4.0).alias("ratio_in_target"),
            m["share"].alias("script_share"),
            m["artifacts"].alias("n_artifacts"),
            ((m["share"] >= 70) & (m["artifacts"] <= 2)).alias("high_quality"),
        )

    return F.transform(counted, measured)[0]  # binds the counts, so they are taken once


# ---- splitters: DataFrame with body and metadata in, the same with ``pieces`` out ----

Splitter = Callable[[DataFrame, dict], DataFrame]


def _piece(text: Column, metadata: Column, n_tokens: Column) -> Column:
    sized = meta.overlay(metadata, F.create_map(F.lit("size_in_tokens"), n_tokens.cast("string")))
    return F.struct(text.alias("page_content"), sized.alias("metadata"), n_tokens.alias("n_tokens"))


def recursive_splitter(df: DataFrame, config: dict) -> DataFrame:
    size, overlap = config.get("chunk_size", 500), config.get("chunk_overlap", 50)
    df = recursive_split(df, F.array("body"), size, overlap, -1, counter=config.get("counter"), spent=("body",))
    own = F.col("metadata")
    return df.withColumn("pieces", F.transform("_cut", lambda c: _piece(c["text"], own, c["n_tokens"])))


def window_splitter(df: DataFrame, config: dict) -> DataFrame:
    windows = fixed_windows(F.col("body"), config.get("chunk_size", 1000), config.get("chunk_overlap", 200))
    own = F.col("metadata")
    counted = F.transform(windows, lambda t: F.struct(t.alias("text"), token_count(t).alias("n_tokens")))
    return df.withColumn("pieces", F.transform(counted, lambda c: _piece(c["text"], own, c["n_tokens"])))


def header_splitter(df: DataFrame, config: dict) -> DataFrame:
    """Header sections, oversized ones split further, a short tail merged: column ``_cut``."""
    size, overlap = config.get("chunk_size", 500), config.get("chunk_overlap", 50)
    sections = header_sections(F.col("body"), config.get("header_levels", [1]))
    texts = F.transform(sections, lambda s: s["text"])
    df = recursive_split(df, texts, size, overlap, counter=config.get("counter"), spent=("body",))
    if config.get("min_tail"):
        merged = merge_short_tail(F.col("_cut"), size, config["min_tail"], config.get("min_seam", 10))
        df = df.withColumn("_cut", merged)
    own = F.col("metadata")
    return df.withColumn("pieces", F.transform("_cut", lambda c: _piece(c["text"], own, c["n_tokens"])))


def page_splitter(df: DataFrame, config: dict) -> DataFrame:
    """Header split for extracted pages: files inlined, mark-up flattened, page header in front.

    ``config`` may name columns: title, tags, images, documents, external_links, internal_links.
    """
    none = F.array().cast("array<struct<text:string,url:string>>")
    links = {k: F.col(config[k]) if config.get(k) else none for k in ("images", "documents", "external_links", "internal_links")}
    page_fields = meta.overlay(
        F.col("metadata"),
        meta.overlay(
            meta.link_fields(links["internal_links"], "internal_links"),
            meta.link_fields(links["external_links"], "external_links"),
        ),
    )
    header = meta.chunk_header(F.col(config["title"]), F.col(config["tags"])) if config.get("title") else F.lit("")
    df = header_splitter(df, config).withColumns({"_fields": page_fields, "_header": header})

    def inlined(c: Column) -> Column:
        pictured = meta.inline_files(c["text"], links["images"], "files__images")
        filed = meta.inline_files(pictured["text"], links["documents"], "files__documents")
        return F.struct(
            filed["text"].alias("text"),
            meta.overlay(pictured["metadata"], filed["metadata"]).alias("files"),
            c["n_tokens"].alias("n_tokens"),
        )

    def finished(c: Column) -> Column:
        flat = F.regexp_replace(c["text"], r"\s*#{1,6}\s*", " ")
        body = F.trim(F.array_join(F.split(flat, r"\s+"), " "))
        fields = meta.drop_empty_values(meta.overlay(F.col("_fields"), c["files"]))
        return _piece(F.concat(F.col("_header"), body), fields, c["n_tokens"])

    return df.withColumn("pieces", F.transform(F.transform("_cut", inlined), finished))


def legal_splitter(df: DataFrame, config: dict) -> DataFrame:
    """Adaptive split: by headings or by size, chunks under 100 tokens left out, small ones merged."""
    smallest, largest = config.get("min_chunk_size", 500), config.get("max_chunk_size", 1200)
    overlap, least = config.get("chunk_overlap", 100), config.get("drop_below", 100)
    cap, body, own = min(largest, 800), F.col("body"), F.col("metadata")

    def shaped(pieces: str) -> Column:
        return merge_small(F.filter(pieces, lambda c: c["n_tokens"] >= least), smallest, largest)

    by_headings = split_strategy(body) == "markdown"
    sections = F.when(by_headings, F.transform(header_sections(body, [1, 2, 3, 4]), lambda s: s["text"]))
    keep = F.when(by_headings, F.lit(largest)).otherwise(F.lit(-1))
    first = F.coalesce(sections, F.array("body"))
    df = recursive_split(df, first, cap, overlap, keep, LEGAL_SEPARATORS, out="_first")
    df = df.withColumn("_shaped", shaped("_first")).drop("_first")
    # Too few chunks: cut again with a smaller size. Other rows have no work in the second pass.
    short = token_count(body) < 1000
    df = recursive_split(
        df,
        F.when(F.size("_shaped") < 2, F.array("body")),
        F.when(short, F.lit(600)).otherwise(F.lit(cap)),
        F.when(short, F.lit(100)).otherwise(F.lit(overlap)),
        -1,
        LEGAL_SEPARATORS[1:],
        out="_again",
        spent=("body",),
    )
    df = df.withColumn("_cut", F.when(F.col("_again").isNotNull(), shaped("_again")).otherwise(F.col("_shaped")))
    measured = F.transform("_cut", lambda c: with_quality(c, smallest, largest, config.get("letters", CYRILLIC)))

    def one(q: Column, i: Column) -> Column:
        names = [
            "n_chars", "char_token_ratio", "in_target_range", "ratio_in_target", "script_share", "n_artifacts", "high_quality",
        ]
        fields = [x for name in names for x in (F.lit(name), q[name].cast("string"))]
        numbered = F.create_map(F.lit("chunk_number"), (i + 1).cast("string"), *fields)
        return _piece(q["text"], meta.overlay(own, numbered), q["n_tokens"])

    return df.withColumn("pieces", F.transform(measured, one))


def python_splitter(split: Callable[[str, dict], list[tuple[str, dict]]]) -> Splitter:
    """A splitter from a plain function of a text and its config giving (text, metadata) pairs."""
    row = T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
    )

    def splitter(df: DataFrame, config: dict) -> DataFrame:
        @F.pandas_udf(T.ArrayType(row))
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"text": c, "extra": m} for c, m in split(t, config)], na_action="ignore")

        own = F.col("metadata")
        return df.withColumn("_cut", run("body")).withColumn(
            "pieces",
            F.transform("_cut", lambda c: _piece(c["text"], meta.overlay(own, c["extra"]), token_count(c["text"]))),
        )

    return splitter


SPLITTERS: dict[str, Splitter] = {
    "recursive": recursive_splitter,
    "header": header_splitter,
    "page": page_splitter,
    "legal": legal_splitter,
    "window": window_splitter,
}


def register_splitter(name: str, splitter: Splitter) -> None:
    SPLITTERS[name] = splitter


# ---- jobs ----


def chunk_contents(
    contents: DataFrame, splitter: str, config: dict, report_id: int | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Chunks of (content_id, body, metadata map): one row each with its position in the document.

    ``carry`` names further columns to hand on to the chunks.
    """
    named = [v for v in config.values() if isinstance(v, str)]  # a splitter reads no other column than those its config names
    needed = {"content_id", "body", "metadata", *carry, *named}
    given = contents.select(*[c for c in contents.columns if c in needed])
    if "body" in carry:  # splitters may use the body up
        split = SPLITTERS[splitter](given.withColumn("_body", F.col("body")), config).drop("body").withColumnRenamed("_body", "body")
    else:
        split = SPLITTERS[splitter](given, config)
    plain = {k: v for k, v in config.items() if not callable(v)}
    return split.select(
        "content_id",
        *carry,
        # "outer": no filter on the size of the array is derived, which would compute the pieces twice
        F.posexplode_outer("pieces").alias("ordinal", "c"),
    ).filter("c IS NOT NULL").select(
        "content_id",
        *carry,
        "ordinal",
        F.lit("ready").alias("status"),
        "c.page_content",
        "c.metadata",
        F.lit(splitter).alias("splitter"),
        F.to_json(F.create_map(*[F.lit(str(x)) for kv in plain.items() for x in kv])).alias("splitter_config")
        if plain
        else F.lit("{}").alias("splitter_config"),
        F.lit(report_id).cast("long").alias("report_id"),
        F.col("c.n_tokens").alias("size_in_tokens"),
    )


def usable(contents: DataFrame) -> DataFrame:
    return contents.filter(F.col("body").isNotNull() & (strip(F.col("body")) != ""))


def unusable(contents: DataFrame, reason: str = "empty body") -> DataFrame:
    """Rows a chunk job leaves out, with the reason, for a quarantine table."""
    return contents.filter(F.col("body").isNull() | (strip(F.col("body")) == "")).withColumn("error", F.lit(reason))


def document_bodies(documents: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Body of every document to chunk: a file card for output 'f', the cleaned text for 't'.

    A text document without cleaned content is left out.
    """
    card = F.concat(
        "title",
        F.when(F.col("description") != "", F.concat(F.lit(" "), "description")).otherwise(""),
        F.lit(" [Ссылка на файл]"),
        "file_url",
    )
    cards = documents.filter("output_format = 'f'").withColumn("body", card)
    texts = documents.filter("output_format = 't'").join(cleaned.select("source_id", "body"), "source_id")
    return cards.unionByName(texts)
