"""Raw pages to content rows: clean Markdown, title, tags, images and classified links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import fixed
from corpusmill.functions.html import PageConfig, read_page
from corpusmill.functions.text import normalize_text, remove_emoji, strip

LINKS = "array<struct<text:string,url:string>>"
READ_SCHEMA = (
    "page_id long, url string, title string, tags array<string>,"
    " blocks array<struct<tag:string,text:string,list_depth:int,number:int,first:boolean>>,"
    f" links {LINKS}, removed_links {LINKS}, images {LINKS}, error string"
)
_LINKS = pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())]))
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("tags", pa.list_(pa.string())),
        (
            "blocks",
            pa.list_(
                pa.struct(
                    [
                        ("tag", pa.string()), ("text", pa.string()), ("list_depth", pa.int32()),
                        ("number", pa.int32()), ("first", pa.bool_()),
                    ]
                )
            ),
        ),
        ("links", _LINKS), ("removed_links", _LINKS), ("images", _LINKS), ("error", pa.string()),
    ]
)
BATCH = 256  # pages turned into one Arrow batch


def read_pages(
    pages: DataFrame, config: PageConfig = PageConfig(), reader=read_page, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Run a page reader over (page_id, url, html). A page that fails keeps its row with the error.

    ``carry`` names further columns to hand on.
    """

    def read(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part, rows = batch.slice(start, BATCH), []
                for row in part.select(["page_id", "url", "html"]).to_pylist():
                    known = {"page_id": row["page_id"], "url": row["url"]}
                    try:
                        rows.append(known | reader(row["url"], row["html"], config))
                    except Exception as error:  # any malformed page
                        rows.append(known | {"error": f"{type(error).__name__}: {error}"})
                made = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                handed = [part.column(name) for name in carry]
                yield pa.RecordBatch.from_arrays([*made.columns, *handed], [*made.schema.names, *carry])

    raw = pages.select("page_id", "url", "html", *carry)
    schema = T.StructType([*T.StructType.fromDDL(READ_SCHEMA).fields, *raw.schema.fields[3:]])
    return raw.mapInArrow(read, schema)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def is_internal(url: Column, page_url: Column) -> Column:
    """Same host and no file: a link to another page of the site."""
    ending = F.regexp_extract(F.lower(path_of(url)), r"\.([^./]*)$", 1)
    return (host_of(url) == host_of(page_url)) & ~ending.isin(fixed.NON_PAGE_EXTENSIONS)


def is_external(url: Column, page_url: Column) -> Column:
    return (host_of(url) != "") & (host_of(url) != host_of(page_url))


def is_document(url: Column) -> Column:
    bare = F.regexp_replace(F.lower(url), r"\?[^?]*$", "")
    picture = "|".join(rf"\.{e}" for e in fixed.PICTURE_LINK_EXTENSIONS)
    return F.regexp_extract(bare, r"\.([^.]*)$", 1).isin(fixed.DOCUMENT_EXTENSIONS) & ~bare.rlike(picture)


def absolute(href: Column, page_url: Column) -> Column:
    """Absolute form of absolute, scheme-relative and root-relative references."""
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    return (
        F.when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(scheme, F.lit("://"), host_of(page_url), href))
        .otherwise(href)
    )


def link_table(read: DataFrame) -> DataFrame:
    """One row per link of a read page with the three kinds it may have."""
    links = read.select("page_id", F.col("url").alias("page_url"), F.explode(F.concat("links", "removed_links")).alias("l"))
    return classify_links(links.select("page_id", "page_url", "l.text", "l.url"))


def classify_links(links: DataFrame) -> DataFrame:
    """Add is_internal, is_external and is_document to (page_id, page_url, text, url)."""
    url, page_url = F.col("url"), F.col("page_url")
    return links.withColumns(
        {
            "is_internal": is_internal(url, page_url),
            "is_external": is_external(url, page_url),
            "is_document": is_document(url),
        }
    )


def internal_links(links: DataFrame) -> DataFrame:
    """Distinct page links of the site, each with its longest text."""
    longest = F.max_by("text", F.struct(F.length("text"), "text")).alias("text")
    return links.filter("is_internal").groupBy("page_id", "url").agg(longest)


def document_links(links: DataFrame) -> DataFrame:
    return links.filter("is_document").select("page_id", "text", "url").distinct()


def external_links(links: DataFrame) -> DataFrame:
    """Links to other hosts, repeated ones kept."""
    return links.filter("is_external").select("page_id", "text", "url")


def markdown(blocks: Column) -> Column:
    """Lines of Markdown from text blocks: numbered top lists, bulleted inner ones, # headings, tables."""

    def line(b: Column) -> Column:
        text, depth = b["text"], b["list_depth"]
        indent = F.repeat(F.lit("    "), F.greatest(depth - 1, F.lit(0)))
        return (
            F.when(b["tag"] == "table", F.concat(F.when(b["first"], "\n").otherwise(""), F.repeat(F.lit("    "), depth), text))
            .when((b["tag"] == "li") & (depth == 1), F.concat(b["number"].cast("string"), F.lit(". "), text))
            .when(b["tag"] == "li", F.concat(indent, F.lit("- "), text))
            .when(
                b["tag"].isin("h1", "h2", "h3", "h4"),
                F.concat(F.repeat(F.lit("#"), F.substring(b["tag"], 2, 1).cast("int")), F.lit(" "), text),
            )
            .otherwise(text)
        )

    shown = F.filter(blocks, lambda b: (b["text"] != "") | b["tag"].isin("li", "h1", "h2", "h3", "h4"))
    return strip(F.array_join(F.transform(shown, line), "\n"))


def extract_pages(
    pages: DataFrame,
    config: PageConfig = PageConfig(),
    normalize: bool = False,
    drop_emoji: bool = False,
    reader=read_page,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Content rows of raw pages (page_id, url, html)."""
    read = read_pages(pages, config, reader, carry)
    content = markdown(F.col("blocks"))
    if normalize:
        content = normalize_text(content)
    if drop_emoji:
        content = remove_emoji(content)
    here = F.col("url")
    return read.select(
        "page_id",
        "url",
        "title",
        "tags",
        content.alias("content"),
        F.array_distinct("images").alias("images"),
        F.array_distinct(F.filter("links", lambda x: is_document(x["url"]))).alias("documents"),
        F.filter("links", lambda x: is_external(x["url"], here)).alias("external_links"),
        _longest_texts(F.col("removed_links")).alias("internal_links"),
        "error",
        *carry,
    )


def _longest_texts(links: Column) -> Column:
    """One entry per URL of a page with its longest text, in order of these entries' first places.

    Sorted by URL, an entry is the best of its URL if the next one has another URL.
    """
    placed = F.transform(
        links, lambda x, i: F.struct(x["url"].alias("url"), F.length(x["text"]).alias("n"), x["text"].alias("text"), (-i).alias("place"))
    )

    def best(entries: Column) -> Column:
        return F.filter(entries, lambda x, i: ~F.get(entries, i + 1)["url"].eqNullSafe(x["url"]) | (i == F.size(entries) - 1))

    kept = F.transform(F.array(F.array_sort(placed)), best)[0]  # bound to a name, so it is sorted once
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct((-x["place"]).alias("place"), x["text"].alias("text"), x["url"].alias("url"))))
    return F.transform(ordered, lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url")))
