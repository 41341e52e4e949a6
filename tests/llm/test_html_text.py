"""Main text against hand-made pages, a plain reading of the test table, and long odd pages under a time limit."""

import html
import re
import time

import pytest

from iotrail.llm.html_text import extract, main_text, op13_html_text

LONG = "A paragraph of some length about the matter at hand, with a clause or two."
BLOG = f"""<!doctype html><html><head><title>No</title><style>p{{}}</style></head><body class="has-sidebar">
<div id="header"><h1>Site name</h1><p>A motto of the site that is quite long</p></div>
<ul class="menu"><li><a href="/a">One</a></li><li><a href='/b>'>Two</a></li></ul>
<div class="cookie-notice">We use cookies, and this is a long sentence about how we use them all.</div>
<div class="post"><h2>Title &amp; more</h2><p>{LONG}</p><p>{LONG} <a href=x>link</a></p>
<div class="ad">Buy now, buy here, buy often, and do not forget to buy again tomorrow.</div>
<h3>Part</h3><ul><li>first thing<li>second thing</ul><table><tr><td>cell one<td>cell two</table>
<script>document.write("<p>never</p>")</script><p>{LONG}<br>End&nbsp;of it.</div>
<div id="comments"><p>{LONG} says a reader.</p></div><form><p>{LONG} Send.</p></form>
<aside>{LONG}</aside><footer>{LONG}</footer></body></html>"""


def test_article_among_everything_else():
    assert main_text(BLOG).split("\n") == ["Title & more", LONG, f"{LONG} link", "Part", "first thing", "second thing", "cell one", "cell two", f"{LONG} End of it."]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &lt;text&gt;\n and more", "plain <text> and more"),
        ("<p>one<p>two", "one\ntwo"),
        ("<nav>menu</nav><script>x</script>", ""),
        ("<p>a < b & c <!-- note --> d", "a < b & c d"),
        ("<p>whole <b>bold<p>next</b>", "whole bold\nnext"),
        ('<p>before<a title="never closed>and</a> after', "beforeand after"),
        ("<article><header><h1>Title</h1><p>by them</p></header><p>text</article>", "Title\ntext"),
        (f"<article><section><h2>S</h2><p>{LONG}</p><p>{LONG}</p></section><section><p>short</p></section></article><p>x", f"S\n{LONG}\n{LONG}\nshort"),
        ('<article><h1>T</h1><p>short.</article><div class="ad">A far longer advert than the article it stands beside.</div>', "T\nshort."),
        (f'<div class="post-with-comments"><p>{LONG}</p></div>', LONG),
        ("<body><div>&#65;&#x42;&eacute;&unknown;</div>", "ABé&unknown;"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", "<b><div>" * 50_000 + "</b>" * 50_000, "<table><td>" * 50_000 + "</p>" * 50_000, "<" * 500_000, "<a '\"<b '>" * 50_000, "<li><ul>" * 50_000, "&" * 500_000, "<!--" * 200_000, "<p class='" + "aB" * 300_000 + "'>x", "<p>" + "word " * 1_000_000],
    ids=range(10),
)
def test_time_is_linear_on_odd_pages(page):
    started = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - started < 20


def test_rows_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, "u", "<p>one"), (1, "u", "<p>one"), (None, None, None), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted([(1, "u", "one", 3), (1, "u", "one", 3), (None, None, "", 0), (2, None, "", 0)], key=str)
    assert sorted(map(tuple, extract(df).collect()), key=str) == want
    from pyspark.sql import functions as F

    assert sorted(map(tuple, extract(df.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))).collect()), key=str) == want
    assert extract(df.limit(0)).collect() == []


def test_registered_query_on_the_table(spark):
    def plain(page: str) -> str:
        article = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", article)]
        return "\n".join(x for x in blocks if x)

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op13_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for row in got:
        text = plain(pages[row.page_id].html)
        assert (row.url, row.text, row.n_chars) == (pages[row.page_id].url, text, len(text))
