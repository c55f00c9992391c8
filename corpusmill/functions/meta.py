"""Functions on lists, maps, links and JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import fixed
from corpusmill.functions.text import strip


def label_of(code: Column, labels: dict[str, str]) -> Column:
    """Display label of a code; an unknown code is shown as it is."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, code), code)


def merge_unique(a: Column, b: Column) -> Column:
    """First occurrences of both lists in order; NULL counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def clean_unique(lines: Column) -> Column:
    """Lines split on commas and line ends, quotes dropped, trimmed, distinct and sorted."""
    parts = F.flatten(F.transform(lines, lambda s: F.split(F.translate(s, '\n"', ","), ",")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, strip), lambda p: p != "")))


def comma_list(c: Column) -> Column:
    """Comma-separated items, trimmed, outer double quotes dropped, blanks dropped."""
    items = F.transform(F.split(c, ","), lambda s: F.btrim(strip(s), F.lit('"')))
    return F.filter(items, lambda s: s != "")


def plain_comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda s: s != "")


def router_list(c: Column) -> Column:
    """A JSON list, single quotes allowed, else a comma list."""
    as_json = F.translate(c, "'", '"')
    listed = F.when(strip(c).rlike(r"^\[[\s\S]*\]$"), F.from_json(as_json, "array<string>"))
    return F.coalesce(listed, plain_comma_list(c))


def overlay(base: Column, patch: Column) -> Column:
    """Union of two maps where the patch wins, whatever the session's duplicate key policy."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, patch)


def drop_empty_values(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def link_fields(links: Column, prefix: str) -> Column:
    """array<struct<text,url>> to {prefix__i: 'text url'}."""
    return F.map_from_entries(
        F.transform(
            links,
            lambda x, i: F.struct(
                F.concat(F.lit(prefix + "__"), i.cast("string")).alias("key"),
                F.concat_ws(" ", x["text"], x["url"]).alias("value"),
            ),
        )
    )


def chunk_header(title: Column, tags: Column) -> Column:
    """'Categories ... Title ...' line put before every chunk of a page."""
    tail = F.when(F.size(tags) > 1, F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(1))))
    listed = F.when(title.isNull(), tail).otherwise(F.array_remove(tail, title))
    categories = F.when(
        F.size(listed) > 0, F.concat(F.lit(fixed.TAGS_PREFIX), F.array_join(listed, ", "), F.lit(". "))
    )
    heading = F.when(title != "", F.concat(F.lit(fixed.TITLE_PREFIX), title, F.lit(". ")))
    return F.concat(F.coalesce(categories, F.lit("")), F.coalesce(heading, F.lit("")))


def append_materials(text: Column, metadata: Column) -> Column:
    """Add the links kept in the metadata as a bulleted block at the end of the text."""
    wanted = F.map_filter(
        metadata,
        lambda k, v: v.isNotNull()
        & (k.startswith("files__documents") | k.startswith("files__images") | k.startswith("external_links")),
    )
    bullets = F.transform(F.map_values(wanted), lambda v: F.concat(F.lit("\n- "), v))
    block = F.concat(F.lit("\n\n" + fixed.LINKS_HEADING), F.array_join(bullets, ""))
    return F.when(F.size(bullets) > 0, F.concat(text, block)).otherwise(text)


def append_source_url(text: Column, url: Column) -> Column:
    return F.when(url.startswith("http"), F.concat(text, F.lit(fixed.SOURCE_LINE), url)).otherwise(text)


def inline_files(text: Column, files: Column, prefix: str) -> Column:
    """Replace each file URL found in the text by its name and list it in the metadata.

    ``files`` is array<struct<text,url>>. Returns struct<text, metadata>.
    """

    def step(acc: Column, item: Column) -> Column:
        url, given = item["url"], F.when(item["text"] != "", item["text"])
        pattern = F.concat(F.lit(r"!\[([^\]]*)\]\("), F.lit(r"\Q"), url, F.lit(r"\E\)"))
        pictured = F.rlike(acc["text"], pattern)
        alt = F.call_function("regexp_extract", acc["text"], pattern, F.lit(1))
        name = F.coalesce(given, F.when(pictured, alt), url)
        replaced = F.when(pictured, F.regexp_replace(acc["text"], pattern, F.lit("$1"))).otherwise(
            F.replace(acc["text"], url, name)
        )
        found = pictured | acc["text"].contains(url)
        entry = F.struct(
            F.concat(F.lit(prefix + "__"), acc["at"].cast("string"), F.lit("__1")).alias("key"),
            F.concat_ws(" ", name, url).alias("value"),
        )
        return F.struct(
            F.when(found, replaced).otherwise(acc["text"]).alias("text"),
            F.when(found, F.array_append(acc["entries"], entry)).otherwise(acc["entries"]).alias("entries"),
            (acc["at"] + 1).alias("at"),
        )

    start = F.struct(
        text.alias("text"),
        F.array().cast("array<struct<key:string,value:string>>").alias("entries"),
        F.lit(0).alias("at"),
    )
    return F.aggregate(
        files,
        start,
        step,
        lambda acc: F.struct(acc["text"].alias("text"), F.map_from_entries(acc["entries"]).alias("metadata")),
    )


def stage_report(facts: dict[str, Column], labels: dict[str, str]) -> Column:
    """'# label: a, b' per fact list, with a fixed text for an empty one."""
    lines = [
        F.concat(
            F.lit(f"# {labels[name]}: "),
            F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(F.lit(fixed.NOT_FOUND_TEXT)),
        )
        for name, values in facts.items()
    ]
    return F.array_join(F.array(*lines), "\n")


def _pruned(value, drop):
    """The value without leaves to drop and without [] and {} at any depth; None when nothing is left."""
    if isinstance(value, dict):
        kept = {k: p for k, v in value.items() if (p := _pruned(v, drop)) is not None}
    elif isinstance(value, list):
        kept = [p for v in value if (p := _pruned(v, drop)) is not None]
    else:
        return None if drop(value) else value
    return kept or None


def _leaves(value, path: tuple[str, ...] = ()):
    """(path, leaf) pairs of a nested value."""
    if isinstance(value, (dict, list)):
        members = value.items() if isinstance(value, dict) else enumerate(value)
        for name, member in members:
            yield from _leaves(member, (*path, str(name)))
    else:
        yield path, value


def _flat(value) -> dict[str, str | None]:
    return {"_".join(path): v if v is None or isinstance(v, str) else json.dumps(v) for path, v in _leaves(value)}


_MAP = T.MapType(T.StringType(), T.StringType())


@F.pandas_udf(T.StructType([T.StructField(name, _MAP) for name in ("everything", "without_empty", "without_false")]))
def flat_json_forms(texts: pd.Series) -> pd.DataFrame:
    """Nested JSON to three maps {a_b_0: leaf} from one parse; NULL when the text is no JSON.

    ``without_empty`` leaves out null, '', [] and {} at every depth, ``without_false`` also 0 and false.
    """
    forms = []
    for text in texts:
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            forms.append((None, None, None))
            continue
        pruned = [_pruned(value, drop) or {} for drop in (lambda v: v is None or v == "", lambda v: not v)]
        forms.append(tuple(_flat(v) for v in (value, *pruned)))
    return pd.DataFrame(forms, columns=["everything", "without_empty", "without_false"], dtype=object)


def flatten_json(c: Column) -> Column:
    """Nested JSON to {a_b_0: leaf}; NULL when the text is no JSON."""
    return flat_json_forms(c)["everything"]


def flatten_json_without_empty(c: Column) -> Column:
    """As ``flatten_json`` with null, '', [] and {} left out at every depth (0 and false stay)."""
    return flat_json_forms(c)["without_empty"]


def flatten_json_without_false(c: Column) -> Column:
    """As ``flatten_json`` with all of null, '', [], {}, 0 and false left out at every depth."""
    return flat_json_forms(c)["without_false"]
