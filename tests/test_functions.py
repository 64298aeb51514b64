"""Vectors of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hitloom.functions.dates import parse_result_date, strip_date_prefix
from hitloom.functions.keys import cache_key
from hitloom.functions.lookups import map_locale, time_range_code
from hitloom.functions.text import (
    decode_entities,
    ellipsize,
    format_cents,
    merge_shadow_text,
    quote_bangs,
    trim_space,
    truncate_text,
)
from hitloom.functions.urls import absolute_url, normalize_url, query_escape, url_host


def column(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("o"))
    return [r["o"] for r in df.orderBy("i").collect()]


URLS = [
    ("https://www.Example.com/Path/", "https://example.com/Path"),
    ("https://example.com#frag", "https://example.com"),
    ("https://example.com", "https://example.com"),
    ("https://WWW.EXAMPLE.COM", "https://example.com"),
    ("not-a-url", "not-a-url"),
    ("https://example.com:8080/path", "https://example.com:8080/path"),
    ("https://www.example.com", "https://example.com"),
    ("https://example.com/a//", "https://example.com/a/"),
    ("https://example.com/?q=1#x", "https://example.com?q=1"),
    ("HTTP://u:p@WWW.www.x.org/a", "http://u:p@www.x.org/a"),
    ("https://ex ample.com/a/", "https://ex ample.com/a/"),
    ("https://example.com/%zz/", "https://example.com/%zz/"),
    ("https://example.com/a b", "https://example.com/a%20b"),
    ("https://example.com/ü", "https://example.com/%C3%BC"),
    ("https://example.com/a%2Fb", "https://example.com/a%2Fb"),
    ("https://example.com/(a)", "https://example.com/(a)"),
    ("https://example.com/(a)/", "https://example.com/%28a%29"),
    ("https://example.com:abc/x/", "https://example.com:abc/x/"),
    ("mailto:someone@Example.com/", "mailto:someone@Example.com/"),
    (":bad/", ":bad/"),
    ("a_b:c/", "a_b:c/"),
    ("", ""),
]


def test_normalize_url(spark):
    assert column(spark, [u for u, _ in URLS], normalize_url) == [n for _, n in URLS]


def test_plain_urls_follow_the_full_rules(spark):
    """The one-pattern path gives what the full rules give, on odd URLs too."""
    import random

    from hitloom.functions.text import let
    from hitloom.functions.urls import _normalize_any

    rng = random.Random(11)
    hosts = ["Example.com", "www.EXAMPLE.com", "wWw.www.x.org", "a-b.c:80", "x:", "www.", "h_x", "é.com",
             "u@h", "[::1]:8", "", "w.com:1a"]
    paths = ["", "/", "//", "/a/", "/a//", "/A.b/c~d", "/a%2Fb/", "/a%zz", "/(a)/", "/a b", "/ü/", "/x;y=1@z:w/"]
    queries = ["", "?", "?q=1&r=/x/", "?a b", "?x?y", "?%zz", "?é"]
    fragments = ["", "#", "#top", "#a#b", "#%41", "#%z", "#a/"]
    schemes = ["https://", "http://", "HTTPS://", "ftp://", "//", "", "mailto:", "x+y.z://", "1a://"]
    urls = [
        "".join(rng.choice(p) for p in (schemes, hosts, paths, queries, fragments)) for _ in range(4000)
    ]
    df = spark.createDataFrame([(u,) for u in set(urls)], "u string")
    both = df.select("u", normalize_url(F.col("u")).alias("a"), let(F.col("u"), _normalize_any).alias("b"))
    assert both.filter("not a <=> b").collect() == []


def test_url_host(spark):
    urls = ["https://Example.com:80/a", "not-a-valid-url", "/rel", "https://a b/", "//h/x"]
    assert column(spark, urls, url_host) == ["Example.com:80", "", "", None, "h"]


def test_query_escape(spark):
    assert column(spark, ["a b~*ü/&"], query_escape) == ["a+b~%2A%C3%BC%2F%26"]


def test_absolute_url(spark):
    out = column(spark, ["/th?id=1", "https://x/y", ""], lambda c: absolute_url(c, "https://s.org"))
    assert out == ["https://s.org/th?id=1", "https://x/y", ""]


NOW = dt.datetime(2026, 3, 31, 12, 30, 15)
DATES = [
    ("Mar 15, 2026", dt.datetime(2026, 3, 15)),
    ("  mar 5,  2026 ", dt.datetime(2026, 3, 5)),
    ("3 minutes ago", NOW - dt.timedelta(minutes=3)),
    ("1 hour ago", NOW - dt.timedelta(hours=1)),
    ("5 days ago", NOW - dt.timedelta(days=5)),
    ("2 weeks ago", NOW - dt.timedelta(weeks=2)),
    ("2 Weekss", NOW - dt.timedelta(weeks=2)),
    ("1 month ago", dt.datetime(2026, 3, 3, 12, 30, 15)),
    ("2 years ago", dt.datetime(2024, 3, 31, 12, 30, 15)),
    ("-1 day", NOW + dt.timedelta(days=1)),
    ("12345678 minutes ago", NOW - dt.timedelta(minutes=12345678)),
    ("0000000003 days ago", NOW - dt.timedelta(days=3)),
    ("10000 months ago", dt.datetime(1192, 12, 1, 12, 30, 15)),
    ("99999999999999999999999 days ago", None),
    ("-9223372036854775808 weeks", None),
    ("9000 years ago", None),
    ("", None),
    ("garbage text", None),
    ("5", None),
    ("3 decades ago", None),
    ("Feb 30, 2026", None),
    ("March 15, 2026", None),
]


def test_parse_result_date(spark):
    now = F.lit("2026-03-31 12:30:15").cast("timestamp_ntz")
    out = column(spark, [d for d, _ in DATES], lambda c: parse_result_date(c, now))
    assert out == [want for _, want in DATES]


def test_leap_day_runs_over(spark):
    now = F.lit("2024-02-29 00:00:00").cast("timestamp_ntz")
    out = column(spark, ["1 year ago"], lambda c: parse_result_date(c, now))
    assert out == [dt.datetime(2023, 3, 1)]


def strip(spark, snippet, date, mode="chars"):
    now = F.lit("2026-03-31").cast("timestamp_ntz")
    d = F.lit(date)
    fn = lambda c: strip_date_prefix(c, d, parse_result_date(d, now), mode)
    return column(spark, [snippet], fn)[0]


def test_strip_date_prefix(spark):
    assert strip(spark, "3 minutes ago - Recent content.", "3 minutes ago") == "Recent content."
    assert strip(spark, "2 weeks ago - Old content.", "2 weeks ago") == "Old content."
    assert strip(spark, "3 minutes ago some news", "3 minutes ago") == "ws"
    assert strip(spark, "3 minutes ago some news", "3 minutes ago", "prefix") == "some news"
    assert strip(spark, "- kept", "no date") == "- kept"


BANGS = [
    ("hello world", "hello world"), ("!g", "'!g'"), ("!g test", "'!g' test"),
    ("test !g query", "test '!g' query"), ("!a !b !c", "'!a' '!b' '!c'"),
    ("no bangs here", "no bangs here"), ("!", "!"), ("!!", "'!!'"),
    ("a!b", "a!b"), ("\t!x  !y", "\t'!x'  '!y'"),
]


def test_quote_bangs(spark):
    assert column(spark, [b for b, _ in BANGS], quote_bangs) == [w for _, w in BANGS]


def test_locales(spark):
    out = column(spark, ["", "en-US", "de-DE", "ja-JP", "zh-TW", "zz-ZZ"], map_locale)
    assert [r["kl"] for r in out] == ["wt-wt", "us-en", "de-de", "jp-jp", "tw-tzh", "wt-wt"]
    assert [(r["country"], r["ui_lang"]) for r in out] == [
        ("us", "en-us"), ("us", "en-us"), ("de", "de-de"), ("jp", "ja-jp"), ("tw", "zh-tw"),
        ("us", "en-us"),
    ]


@pytest.mark.parametrize(
    "engine, codes",
    [
        ("brave", ["pd", "pw", "pm", "py", "", ""]),
        ("duckduckgo", ["d", "w", "m", "y", "", ""]),
        ("bingnews", ["4", "7", "9", "9", "", ""]),
        ("brave-news", [""] * 6),
    ],
)
def test_time_range(spark, engine, codes):
    ranges = ["day", "week", "month", "year", "", "bogus"]
    assert column(spark, ranges, lambda c: time_range_code(F.lit(engine), c)) == codes


def test_cache_key(spark):
    import hashlib

    want = hashlib.sha256(b"scrape\0https://x/\0").hexdigest()
    out = column(spark, ["https://x/"], lambda c: cache_key(F.lit("scrape"), c, F.lit(None)))
    assert out == [want]


def go_cut(text: str, n: int) -> str:
    """Byte cut, then every stray byte as U+FFFD."""
    raw = text.encode()[:n]
    for k in range(4):
        try:
            return raw[: n - k].decode() + "�" * k
        except UnicodeDecodeError:
            continue
    raise AssertionError


def test_truncate_bytes(spark):
    text = "aé€😀b"
    for n in range(1, 14):
        want = go_cut(text, n) if n < len(text.encode()) else text
        assert column(spark, [text], lambda c: truncate_text(c, n)) == [want]
    assert column(spark, ["a" * 2000], lambda c: truncate_text(c, 100)) == ["a" * 100]
    assert column(spark, ["a" * 2000], lambda c: truncate_text(c, 0)) == ["a" * 2000]
    assert column(spark, ["aé€"], lambda c: truncate_text(c, 2, "chars")) == ["aé"]


def test_ellipsize(spark):
    assert column(spark, ["x" * 10, "x" * 11, "é" * 11], lambda c: ellipsize(c, 10)) == [
        "x" * 10, "x" * 7 + "...", "é" * 7 + "...",
    ]


def test_format_cents(spark):
    import random

    rng = random.Random(7)
    values = [0.125, 0.375, 1.015, 0.325, 1.275, 1.005, 2.675, 0.285, 1 / 3, 12345.675, 0.995]
    values += [n * sum(1 / rng.randint(1, 10) for _ in range(n)) for n in range(1, 12) for _ in range(40)]
    values += [k / 200 for k in range(1, 4000, 7)]
    out = column(spark, values, format_cents, "double")
    assert out == ["%.2f" % v for v in values]


def test_trim_space(spark):
    assert column(spark, [" \n a b\t "], trim_space) == ["a b"]


def test_decode_entities(spark):
    cases = [
        ("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&#38;lt;", "&lt;"), ("&lt;p&gt;", "<p>"),
        ("&#8364;&#x20AC;&euro;", "€€€"), ("&#x1F600;", "😀"), ("&bogus; &copy;", "&bogus; ©"),
        ("&#0;", "&#0;"), ("no entity", "no entity"), ("AT&T", "AT&T"), ("&amp;&amp;", "&&"),
        ("&copy 2024 &amp", "© 2024 &"), ("&euro 5", "&euro 5"), ("&#8364 5", "€ 5"),
        ("&lt&gt", "<>"), ("&ampx", "&x"), ("it&apos;s &lbrace;", "it's {"), ("&#146;", "’"), ("&frac12 &frac12;", "½ ½"),
        ("&#x0000000041;&#0000000065;", "AA"), ("&#99999999999999999999;&#x110000;&#xD800;", "\ufffd\ufffd\ufffd"),
        ("&CounterClockwiseContourIntegral;", "∳"), ("&NotEqualTilde;", "≂̸"), ("&#x26;lt;", "&lt;"), ("&#129;", "\x81"),
    ]
    assert column(spark, [c for c, _ in cases], decode_entities) == [w for _, w in cases]


def test_merge_shadow_text(spark):
    html = "<html>a</html>b</html>tail"
    want = "<html>a</html>b\n<!-- shadow-dom-content -->\n<pre>S</pre>\n\n</body></html>"
    assert column(spark, [html], lambda c: merge_shadow_text(c, F.lit("S"))) == [want]
    assert column(spark, [html], lambda c: merge_shadow_text(c, F.lit(""))) == [html]
    assert column(spark, ["<p>"], lambda c: merge_shadow_text(c, F.lit("S"))) == ["<p>"]
