from corpusmill.functions.html import PageConfig
from corpusmill.operators import pages as pg

PAGE = """
<html><head><title>no</title></head><body>
<div class="breadcrumbs"><a href="/">Home</a> <a href="/c"> Cat </a><a> </a></div>
<main>
 <nav>menu</nav><!-- note --><div style="display:none">hidden</div><p id="PreLoad">gone</p>
 <h1>Big <b>Title</b></h1>
 <p>Hello <b>bold</b>, see <a href="/doc.pdf?x=1">the doc</a> and <a href="http://other.org/p">other</a></p>
 <p>Go <a href="next.html">on</a> <a href="next.html">on and on</a></p>
 <ul><li>one</li><li>two<ul><li>inner</li></ul></li></ul>
 <p>between</p>
 <ol><li>again</li></ol>
 <div><h2>Lonely</h2><p></p></div>
 <table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>
 <h3></h3><p>under</p>
 <img data-src="/i.png" alt="pic"><img src="/small.png"><img class="size-full" src="/full.png" alt="">
 <script>var x = "<p>no</p>"</script>
</main></body></html>
"""


def extract(spark, html, config=PageConfig(), **options):
    pages = spark.createDataFrame([(1, "http://site.org/a/b.html", html)], "page_id long, url string, html string")
    return pg.extract_pages(pages, config, **options).first()


def test_page(spark):
    row = extract(spark, PAGE)
    assert row["error"] is None
    assert row["title"] == "BigTitle"  # pieces are trimmed and joined as they are
    assert row["tags"] == ["Home", "Cat"]
    assert row["content"].split("\n") == [
        "![pic](http://site.org/i.png) ![](http://site.org/full.png)",
        "# Big Title",
        "Hello bold , see and [the doc](http://site.org/doc.pdf?x=1) [other](http://other.org/p)",
        "Go [on](http://site.org/a/next.html) [on and on](http://site.org/a/next.html)",
        "1. one",
        "2. two",
        "    - inner",
        "between",
        "1. again",
        "",
        "| A | B |",
        "| --- | --- |",
        "| 1 | 2 |",
        "### under",
    ]
    assert [tuple(x) for x in row["images"]] == [("pic", "http://site.org/i.png"), ("", "http://site.org/full.png")]
    assert [tuple(x) for x in row["documents"]] == [("the doc", "http://site.org/doc.pdf?x=1")]
    assert [tuple(x) for x in row["external_links"]] == [("other", "http://other.org/p")]
    assert row["internal_links"] == []


def test_internal_links_are_taken_out(spark):
    row = extract(spark, PAGE, PageConfig(remove_internal_links=True))
    assert [tuple(x) for x in row["internal_links"]] == [("on and on", "http://site.org/a/next.html")]
    assert "next.html" not in row["content"] and "Go" in row["content"]
    assert "doc.pdf" in row["content"]


def test_config_and_fallbacks(spark):
    row = extract(spark, "<h2 class='t x'>Second</h2><div class='k'><p>a\nb</p></div>tail", PageConfig(title_selector="h2.t"))
    assert row["title"] == "Second"
    assert row["content"].split("\n") == ["tail", "## Second", "a b"]


def test_failing_reader_keeps_the_row(spark):
    def broken(url, html, config):
        raise ValueError("bad page")

    row = extract(spark, "<p>x", reader=broken)
    assert row["url"] == "http://site.org/a/b.html" and row["error"] == "ValueError: bad page"


def test_page_urls(one):
    assert one(lambda u, p: pg.is_internal(u, p), u="http://a.b/x.PDF", p="http://a.b/") is False
    assert one(lambda u, p: pg.is_internal(u, p), u="http://a.b/x?y=z.pdf", p="http://a.b/") is True
    assert one(lambda u: pg.is_document(u), u="http://a/img.png/x.txt") is False
    assert one(lambda h, p: pg.absolute(h, p), h="//c.d/e", p="https://a.b/") == "https://c.d/e"


def test_carried_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x", 200)], "page_id long, url string, html string, response_status int")
    row = pg.extract_pages(pages, carry=("response_status",)).first()
    assert (row["content"], row["response_status"]) == ("x", 200)


def test_reference_without_semicolon_stands_for_itself(spark):
    html = '<body><h1>cut &lt;off&amp</h1><p>a &copy b &amp; c &#x2 &#x27;d&#x27; <a href="/x?a=1&copy=2">l</a></p><script>a&b</script></body>'
    row = extract(spark, html)
    assert row["title"] == "cut <off&amp"
    assert row["content"] == "# cut <off&amp\na &copy b & c &#x2 'd' [l](http://site.org/x?a=1&copy=2)"
