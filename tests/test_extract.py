"""Hit extraction: the four rules, filters, numbering, broken HTML, page status."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from hitloom.operators.extract import extract_hits, page_status, warnings
from hitloom.operators.html_hits import page_hits
from hitloom.operators.rules import DEFAULT_RULES, Rule
from hitloom.schemas import RESULT_PAGE

BRAVE = """<body>
<div class="snippet"><a href="https://one.test/p">x</a><div class="title">First</div>
 <div class="content">Plain text.</div></div>
<div class="snippet"><a href="not-a-valid-url">x</a><div class="title">Dropped</div></div>
<div class="snippet"><div class="title">No link</div></div>
<div class="snippet fdb"><a href="https://two.test/p?a=1&amp;b=2">x</a><a href="https://second.test">y</a>
 <div class="title">Sec<b>ond</b></div><span class="t-secondary"> Mar 15, 2026 </span>
 <div class="content">Mar 15, 2026 - Dated text.</div>
 <a class="thumbnail"><img src="https://img.test/2.jpg"></a></div>
<div class="snippet"><a href="https://three.test">x</a><span class="t-secondary">3 minutes ago</span>
 <div class="content">3 minutes ago - Recent.</div></div>
<div class="snippet"><a href="https://four.test">x</a><span class="t-secondary">today</span>
 <div class="content">today - Kept.</div></div>
</body>"""

DUCKDUCKGO = """<div id="links">
<div class="web-result"><h2><a href="https://good.test">Good &amp; well</a></h2>
 <a class="result__snippet">Text <b>bold</b> here.</a></div>
<div class="web-result result--ad"><h2><a href="https://ad.test">Ad</a></h2></div>
<div class="web-result"><h2><a href="https://next.test">Next</a></h2></div></div>
<div class="web-result"><h2><a href="https://outside.test">Outside</a></h2></div>"""

NEWS = """<div data-type="news"><a class="other" href="https://no.test">n</a>
 <a class="result-header" href="https://news.test/1">h</a>
 <span class="snippet-title">News</span><p class="desc">Story.</p>
 <div class="image-wrapper"><img src="https://img.test/n.jpg"/></div></div>
<div data-type="web"><a class="result-header" href="https://web.test">w</a></div>"""

BING = """<div class="newsitem"><a class="title" href="https://bing.test/1">One</a>
 <div class="snippet">S1</div><a class="imagelink"><img src="/th?id=abc"/></a></div>
<div class="newsitem"><a class="title">No address</a></div>
<div class="newsitem"><a class="title" href="/relative">Two</a>
 <a class="imagelink"><img src="https://img.test/b.png"></a></div>"""


def extract(spark, rows, **options):
    pages = spark.createDataFrame(rows, RESULT_PAGE)
    as_of = F.lit("2026-03-31 12:00:00").cast("timestamp_ntz")
    return extract_hits(pages, as_of=as_of, **options).orderBy("query_id", "engine", "position").collect()


def test_brave(spark):
    rows = extract(spark, [(1, "brave", 1, 200, BRAVE)])
    assert [(r["position"], r["url"]) for r in rows] == [
        (1, "https://one.test/p"), (2, "https://two.test/p?a=1&b=2"), (3, "https://three.test"),
        (4, "https://four.test"),
    ]
    assert [r["title"] for r in rows] == ["First", "Second", "", ""]
    assert [r["snippet"] for r in rows] == ["Plain text.", "Dated text.", "Recent.", "today - Kept."]
    assert [r["published"] for r in rows] == [
        None, dt.datetime(2026, 3, 15), dt.datetime(2026, 3, 31, 11, 57), None,
    ]
    assert [r["thumbnail"] for r in rows] == [None, "https://img.test/2.jpg", None, None]
    assert not any(r["cached"] for r in rows)


def test_duckduckgo(spark):
    rows = extract(spark, [(1, "duckduckgo", 1, 200, DUCKDUCKGO)])
    assert [(r["position"], r["url"], r["title"], r["snippet"]) for r in rows] == [
        (1, "https://good.test", "Good & well", "Text bold here."), (2, "https://next.test", "Next", ""),
    ]


def test_news_engines(spark):
    rows = extract(spark, [(1, "brave-news", 1, 200, NEWS), (1, "bingnews", 1, 200, BING)])
    assert [(r["engine"], r["url"], r["thumbnail"]) for r in rows] == [
        ("bingnews", "https://bing.test/1", "https://www.bing.com/th?id=abc"),
        ("bingnews", "/relative", "https://img.test/b.png"),
        ("brave-news", "https://news.test/1", "https://img.test/n.jpg"),
    ]


@pytest.mark.parametrize("engine", [r.name for r in DEFAULT_RULES])
def test_nothing_found(spark, engine):
    pages = [(1, engine, 1, 200, "<div id='links'></div>"), (2, engine, 1, 200, ""), (3, engine, 1, 200, None)]
    assert extract(spark, pages) == []


def test_status_and_warnings(spark):
    form = '<form method="post" id="challenge-form">'
    rows = [
        (1, "duckduckgo", 1, 200, DUCKDUCKGO), (2, "duckduckgo", 1, 303, DUCKDUCKGO),
        (3, "duckduckgo", 2, 202, DUCKDUCKGO), (4, "duckduckgo", 1, 200, form + DUCKDUCKGO),
        (5, "brave", 1, 303, BRAVE), (6, "brave", 1, 200, form + BRAVE), (7, "brave-news", 1, 429, ""),
    ]
    pages = spark.createDataFrame(rows, RESULT_PAGE)
    out = {r["query_id"]: (r["status"], r["error"]) for r in page_status(pages).collect()}
    assert out == {
        1: ("ok", None), 2: ("empty", None), 3: ("failed", "duckduckgo: HTTP 202"),
        4: ("failed", "duckduckgo: captcha challenge detected"), 5: ("failed", "brave: HTTP 303"),
        6: ("ok", None), 7: ("failed", "brave: HTTP 429"),
    }
    assert sorted(r["query_id"] for r in warnings(pages).collect()) == [3, 4, 5, 7]
    assert {r["query_id"] for r in extract(spark, rows)} == {1, 6}


def test_own_rule(spark):
    mine = Rule(name="mine", rank=1, container="li.hit", url="a[href]", title="a", origin="https://o.test")
    html = "<ul><li class=hit><a href=https://x.test/>X<li class='hit'><a href='/y'>Y</a></ul>"
    rows = extract(spark, [(1, "mine", 1, 200, html)], rules=(mine,))
    assert [(r["position"], r["url"], r["title"]) for r in rows] == [
        (1, "https://x.test/", "X"), (2, "/y", "Y"),
    ]


def test_broken_html():
    rule = DEFAULT_RULES[0]
    html = """<!-- <div class="snippet"><a href="no"> --><script>"<div class='snippet'>"</script>
    <div class="snippet"><a href="https://a"><img alt="x > y"><p>one<p>two</div>
    </b></section><div class='snippet' title="<b>"><a href="https://b" href="https://c">
    <div class="title">T &lt; U</div><div class="content">open"""
    assert [(h["url"], h["title"], h["snippet"]) for h in page_hits(html, rule)] == [
        ("https://a", "", ""), ("https://b", "T < U", "open"),
    ]


def test_implied_ends():
    rule = Rule(name="r", rank=1, container="div.c", url="a", title="b", snippet="p.d")
    html = """<div class=c><b>x<div>y</b></div><p class=d>one<i>two<div>no</div>
    <table><tr><td></div><p class=d>in<tr></table><p class=d>three</div>
    <p class=d>outside</p>"""
    hit = page_hits(html, rule)[0]
    assert "".join(hit["snippet"].split()) == "onetwointhree"
    assert len(page_hits(html, rule)) == 1


def test_nested_texts_join():
    rule = Rule(name="r", rank=1, container="div.c", url="a", title=".t", snippet="div.s span")
    html = '<div class=c><a href=u></a><i class="t x">1</i><i class=t>2</i><div class=s><b><span>3</span></b></div></div>'
    hit = page_hits(html, rule)[0]
    assert (hit["url"], hit["title"], hit["snippet"]) == ("u", "12", "3")


@pytest.mark.parametrize("unit", ["<!--", "<script>", "<style>", '<div class="snippet">', '<a x="', "<p><table><div>"])
def test_broken_pages_take_linear_time(unit):
    def seconds(n):
        page = unit * n
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            page_hits(page, DEFAULT_RULES[0])
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(16_000) < 8 * seconds(4_000) + 0.2


def test_open_markup():
    page = '<div class="snippet"><a href="https://a.b/c"></a><div class="title">T</div></div>'
    rule = DEFAULT_RULES[0]
    assert page_hits(page + "<!-- " + page, rule) == page_hits(page, rule)
    assert len(page_hits(page + "<script> " + page, rule)) == 2
    assert len(page_hits(page + "<script> " + page + "</script>" + page, rule)) == 2
