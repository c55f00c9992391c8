"""Page extraction and link queries."""

from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.operators import pages as pg
from corpusmill.plans.registry import query, table

# Independent route for the checked pages: cut out the body, drop excluded parts, split at tags.
def _drop(expr: str, tag: str) -> str:
    return f"regexp_replace({expr}, '(?s)<{tag}[ >].*?(</{tag}>|$)', '', 'g')"


_BODY = _drop(_drop("regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<!--.*?-->', '', 'g')", "nav"), "footer")
_UNESCAPED = "{}"
for _name, _char in {"quot": '"', "#x27": "''", "lt": "<", "gt": ">", "copy": "©", "middot": "·", "amp": "&"}.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', '{_char}')"
_LINES = rf"""
  WITH cut AS (SELECT page_id, url, html, {_BODY} AS body FROM pages),
  marked AS (SELECT page_id, url, html, string_split(regexp_replace(regexp_replace(regexp_replace(body, '</?b>', '', 'g'),
               '<h1>', chr(1) || '# ', 'g'), '<[^>]*>', chr(1), 'g'), chr(1)) AS parts FROM cut)
  SELECT page_id, url, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS raw_title,
    array_to_string(list_filter(list_transform(parts, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10)) AS raw_content
  FROM marked"""


@query(
    "H1, H3, H4, H5, H6, H13, S5",
    f"SELECT page_id, url, {_UNESCAPED.format('raw_title')} AS title, {_UNESCAPED.format('raw_content')} AS content FROM ({_LINES})",
)
def extracted_pages(spark, sf_dir):
    return pg.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "title", "content")


_NAV = _UNESCAPED.format("regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)")
_NAV_TEXTS = f"regexp_extract_all({_NAV}, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)"
_NAV_LINKS = f"regexp_extract_all({_NAV}, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)"


@query(
    "H2, H7, H8, H9, H14",
    f"""SELECT page_id, array_to_string(list_filter(list_transform({_NAV_TEXTS}, lambda t: trim(t)), lambda t: t <> ''), '|') AS tags,
          len(list_distinct({_NAV_LINKS}))::BIGINT AS n_internal, 0::BIGINT AS n_images FROM pages""",
)
def extracted_page_details(spark, sf_dir):
    config = pg.PageConfig(
        excluded_tags=frozenset(fixed.EXCLUDED_TAGS) - {"nav"}, breadcrumb_selector="nav a", remove_internal_links=True
    )
    rows = pg.extract_pages(table(spark, sf_dir, "pages"), config, normalize=True, drop_emoji=True)
    return rows.select(
        "page_id",
        F.array_join("tags", "|").alias("tags"),
        F.size("internal_links").cast("long").alias("n_internal"),
        F.size("images").cast("long").alias("n_images"),
    )


# Links found by one pattern on both sides; each anchor also stands in for a file and for a foreign link.
_ANCHORS = r"""
  WITH a AS (SELECT page_id, url AS page_url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site,
               unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
               unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages),
  links AS (SELECT page_id, page_url, text, site || href AS url FROM a
            UNION ALL SELECT page_id, page_url, text || ' ' || text, site || href FROM a
            UNION ALL SELECT page_id, page_url, text, site || href || '.PDF?v=1' FROM a
            UNION ALL SELECT page_id, page_url, text, 'https://other.example.org' || href FROM a)
"""


def _links(spark, sf_dir):
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    anchors = table(spark, sf_dir, "pages").select(
        "page_id",
        F.col("url").alias("page_url"),
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"),
                F.regexp_extract_all("html", pattern, F.lit(2)).alias("text"),
            )
        ).alias("a"),
    )
    variants = F.array(
        F.struct(F.col("a.text").alias("text"), F.col("a.href").alias("href")),
        F.struct(F.concat_ws(" ", "a.text", "a.text").alias("text"), F.col("a.href").alias("href")),
        F.struct(F.col("a.text").alias("text"), F.concat("a.href", F.lit(".PDF?v=1")).alias("href")),
        F.struct(F.col("a.text").alias("text"), F.concat(F.lit("https://other.example.org"), "a.href").alias("href")),
    )
    links = anchors.select("page_id", "page_url", F.explode(variants).alias("v"))
    found = links.select("page_id", "page_url", "v.text", pg.absolute(F.col("v.href"), F.col("page_url")).alias("url"))
    return pg.classify_links(found)


@query(
    "H8, H9",
    _ANCHORS
    + """SELECT page_id, url, max_by(text, length(text)) AS text FROM links
         WHERE url NOT LIKE '%.PDF?v=1' AND url NOT LIKE 'https://other.example.org%' GROUP BY page_id, url""",
)
def internal_page_links(spark, sf_dir):
    return pg.internal_links(_links(spark, sf_dir))


@query("H10", _ANCHORS + "SELECT DISTINCT page_id, text, url FROM links WHERE url LIKE '%.PDF?v=1'")
def document_page_links(spark, sf_dir):
    return pg.document_links(_links(spark, sf_dir))


@query("H11", _ANCHORS + "SELECT page_id, text, url FROM links WHERE url LIKE 'https://other.example.org%'")
def external_page_links(spark, sf_dir):
    return pg.external_links(_links(spark, sf_dir))
