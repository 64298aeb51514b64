"""Main text and blocks: broken markup, structure, time that follows the length."""

import time

import pytest
from pyspark.sql import functions as F

from hitloom.functions.html import body_text_length, main_text, page_metadata, render_blocks, text_blocks
from hitloom.functions.text import decode_entities

# Markup, and the lines a reader should get of it.
CASES = [
    ("<nav><div><nav>in</nav>tail menu</div></nav><p>kept", "kept"),
    ("<div><form><p>ask</div><p>kept</p>", "kept"),  # an open form ends with its container
    ("<article><p>one</p></article>between<article>two</article>", "one\ntwo"),
    ("<article> </article><p>page", "page"),
    ("<p>a<!-- open <p>b", "a"),
    ("<p>a<!-- <p>no --> b", "a b"),
    ("<p>a<script>x<p>y", "a"),
    ("<head><meta><body><p>x", "x"),
    ("<head><title>t</title></head>x", "x"),
    ("a <button>push</button>b", "a b"),
    ("<p title='1 > 0'>x<p title=\"a>\">y", "x\ny"),
    ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
    ("<div class='big ad'><div>buy</div>now</div>rest", "rest"),
    ('<div class=ads>buy</div><div class="adder">kept</div>', "kept"),
    ("<div data-class='ad'>kept</div>", "kept"),
    ("<article><svg/><p>x</p><svg><text>no</text></svg>y</article>z", "x\ny"),
    ("<aside><article>no</article></aside><p>yes", "yes"),
    ("<article>a<aside>no</article><p>out", "a"),
    ("</nav></article><p>x</p>", "x"),
    ("<table><tr><td>1<td>2</tr><tr><th>3</table>", "1 2\n3"),
    ("<p>&lt;b&gt; &amp;amp; &Eacute;</p>", "<b> &amp; É"),
    ("", ""),
    ("<", "<"),
]


def test_broken_markup(spark):
    df = spark.createDataFrame(list(enumerate(h for h, _ in CASES)), "i int, h string")
    got = [r[1] for r in df.select("i", main_text(F.col("h"))).orderBy("i").collect()]
    assert [(h, g) for (h, w), g in zip(CASES, got) if g != w] == []
    assert spark.createDataFrame([(None,)], "h string").select(main_text(F.col("h"))).first()[0] is None


STRUCTURE = """<article><h2>A <a href="/t">title</a></h2>
<p>See <a href="/x">x</a>, <a>plain</a> and <a href='/x?a=1&amp;b=2'><b>x</b> again</a>.</p>
<table><caption>Cap</caption><tr><th>k</th><td>v <a href=/c>c</a></td></tr><tr><td></td><td>2</td></tr></table>
<ul><li>one<ul><li>inner</ul><li>two</ul><dl><dt>T<dd>D</dl><blockquote>Q\nq</blockquote><pre>code</pre>\x01\x04end</article>"""


def test_blocks(spark):
    df = spark.createDataFrame([(STRUCTURE,)], "h string").select(text_blocks(F.col("h")).alias("b"))
    blocks = df.first()["b"]
    assert [(b.kind, b.text) for b in blocks] == [
        ("h2", "A title"), ("p", "See x, plain and x again."), ("caption", "Cap"), ("tr", "k v c"), ("tr", "2"),
        ("li", "one"), ("li", "inner"), ("li", "two"), ("dt", "T"), ("dd", "D"), ("blockquote", "Q q"), ("pre", "code"),
        ("p", "end"),
    ]
    assert [list(b.cells) for b in blocks[3:5]] == [["k", "v c"], ["", "2"]] and not blocks[1].cells
    assert [tuple(x) for x in blocks[1].links] == [("x", "/x"), ("x again", "/x?a=1&b=2")]
    text = df.select(render_blocks(F.col("b"))).first()[0]
    assert text.split("\n") == [
        "## A [title](/t)", "See [x](/x), plain and [x again](/x?a=1&b=2).", "Cap", "| k | v [c](/c) |", "|  | 2 |",
        "- one", "- inner", "- two", "T", "- D", "> Q q", "code", "end",
    ]


def seconds(spark, fn, html):
    # The text is no constant to the optimizer, and each time is the lesser of two.
    df = spark.createDataFrame([(html,)], "h string").cache()
    df.count()
    times = []
    for _ in range(2):
        start = time.perf_counter()
        df.select(F.length(fn(F.col("h")).cast("string"))).collect()
        times.append(time.perf_counter() - start)
    df.unpersist()
    return min(times)


BROKEN = ["<!--", "<nav>", "<meta ", "<div class='ad ", "<article>", "<", "</nav><nav>", "<title>"]


@pytest.mark.parametrize("piece", BROKEN)
def test_time_follows_the_length(spark, piece):
    def everything(html):
        return F.struct(main_text(html), page_metadata(html), body_text_length(html))

    seconds(spark, everything, piece * 1000)
    once, twice = (seconds(spark, everything, piece * n) for n in (2000, 4000))
    assert twice < 3 * once + 0.1, (once, twice)


def test_entities_are_a_constant(spark):
    """The map of named entities is folded, so a named one costs about what a number does."""
    plan = spark.createDataFrame([("x",)], "t string").select(decode_entities(F.col("t")))
    assert "map(keys: [&Aacute" in plan._jdf.queryExecution().optimizedPlan().toString()
