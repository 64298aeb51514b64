"""Operators against the vectors and against brute force on small tables."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hitloom.functions.html import main_text, page_metadata, sanitize_html
from hitloom.operators import cache as C
from hitloom.operators.attach import NO_SNAPSHOT, attach_pages, pick_snapshot
from hitloom.operators.merge import (
    merge_hits,
    pages_for_limit,
    position_lists,
    rank_results,
    union_hits,
    within_query_limits,
)
from hitloom.operators.records import result_cards, results_json, to_records
from hitloom.operators.requests import plan_requests, select_engines
from hitloom.operators.sanitize import sanitize, strip_html
from hitloom.operators.status import classify_status, health_summary
from hitloom.schemas import HIT, PAGE_CACHE, RECORD, RESULT_CACHE, SNAPSHOT

ENGINES = ["brave", "duckduckgo", "brave-news", "bingnews"]


def hit(query_id=1, engine="brave", page=1, position=1, url="https://example.com", title="t",
        snippet="s", thumbnail=None, published=None, cached=False):
    return (query_id, engine, page, position, url, title, snippet, thumbnail, published, cached)


def hits_of(spark, *rows):
    return spark.createDataFrame(list(rows), HIT)


def test_merge_same_url(spark):
    out = merge_hits(
        hits_of(
            spark,
            hit(engine="duckduckgo", position=2, title="a much longer title", snippet="short"),
            hit(engine="brave", position=1, title="short", snippet="a longer snippet here",
                thumbnail="first", url="https://www.example.com/"),
            hit(engine="brave", page=2, position=1, title="x" * 19, snippet=""),
            hit(url="https://example.com/b"),
        )
    )
    assert out.count() == 2
    row = out.filter("url_key = 'https://example.com'").first()
    assert row["engines"] == ["brave", "duckduckgo"]
    assert row["title"] == "a much longer title"
    assert row["snippet"] == "a longer snippet here"
    assert (row["url"], row["thumbnail"]) == ("https://www.example.com/", "first")
    assert row["n_hits"] == 3 and row["score"] == pytest.approx(3 * 2.5)


def test_merge_empty(spark):
    assert merge_hits(hits_of(spark)).count() == 0


def test_length_is_bytes_and_first_wins_ties(spark):
    out = merge_hits(
        hits_of(spark, hit(position=1, title="abcd"), hit(position=2, title="éé"),
                hit(position=3, title="ééé"))
    ).first()
    assert out["title"] == "ééé"
    out = merge_hits(
        hits_of(spark, hit(position=2, title="éé"), hit(position=1, title="abcd"))
    ).first()
    assert out["title"] == "abcd"


@pytest.mark.parametrize(
    "positions, want", [([1], 1.0), ([1, 2], 3.0), ([3], 1 / 3), ([None], 0.0)]
)
def test_score(spark, positions, want):
    rows = [hit(page=n + 1, position=p) for n, p in enumerate(positions)]
    assert merge_hits(hits_of(spark, *rows)).first()["score"] == want


def test_unknown_engine_stops(spark):
    with pytest.raises(Exception, match="unknown engine other"):
        merge_hits(hits_of(spark, hit(engine="other"))).collect()


def test_own_engine_list(spark):
    rows = [hit(engine="mine", position=2), hit(engine="brave", position=1)]
    out = merge_hits(hits_of(spark, *rows), ["mine", "brave"]).first()
    assert out["engines"] == ["mine", "brave"]


def test_positions_keep_duplicates(spark):
    rows = [hit(position=1), hit(engine="duckduckgo", position=2), hit(page=2, position=1),
            hit(page=2, position=1)]
    out = position_lists(hits_of(spark, *rows))
    assert [tuple(run) for run in out.first()["positions"]] == [(1, 1), (2, 1), (1, 2)]


def brute_rank(rows, limit):
    """Plain Python merge and rank of hit tuples whose URLs are normal already."""
    out = {}
    seen = sorted(rows, key=lambda r: (r[0], r[2], ENGINES.index(r[1]), r[3]))
    for query_id, engine, _, position, url, *_ in seen:
        m = out.setdefault(query_id, {}).setdefault(url, {"e": [], "p": []})
        m["p"].append(position)
        if engine not in m["e"]:
            m["e"].append(engine)
    result = {}
    for query_id, merged in out.items():
        scored = [
            (round(sum(len(m["p"]) / p for p in m["p"]), 9), len(m["e"]), url)
            for url, m in merged.items()
        ]
        scored.sort(key=lambda s: (-s[0], -s[1]))
        result[query_id] = (len(scored), [url for *_, url in scored[:limit]])
    return result


@pytest.mark.parametrize("total", ["recount", "salted", "none"])
def test_rank_with_a_hot_query(spark, total):
    """One query holds most of the rows; all ways of counting agree with brute force."""
    rng = random.Random(3)
    rows = []
    for query_id, size in ((1, 900), (2, 40), (3, 1)):
        slots = list(itertools.product(ENGINES, range(1, 26), range(1, 11)))
        for engine, page, position in rng.sample(slots, size):
            url = f"https://example.com/{rng.randint(1, size)}"
            rows.append(hit(query_id, engine, page, position, url))
    ranked = rank_results(merge_hits(hits_of(spark, *rows)), 7, total)
    want = brute_rank(rows, 7)
    got = {}
    for r in ranked.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert {q: [r["url"] for r in rs] for q, rs in got.items()} == {
        q: urls for q, (_, urls) in want.items()
    }
    if total != "none":
        assert {q: rs[0]["total"] for q, rs in got.items()} == {q: n for q, (n, _) in want.items()}


def test_limit_default(spark):
    rows = [hit(position=p, url=f"https://e.com/{p}") for p in range(1, 31)]
    assert rank_results(merge_hits(hits_of(spark, *rows)), 0).count() == 20


def test_query_limits(spark):
    rows = [hit(q, position=p, url=f"https://e.com/{p}") for q in (1, 2) for p in range(1, 31)]
    ranked = rank_results(merge_hits(hits_of(spark, *rows)), 25, "none")
    queries = spark.createDataFrame([(1, 3), (2, None)], "query_id long, limit int")
    kept = within_query_limits(ranked, queries, 25).groupBy("query_id").count()
    assert {r[0]: r[1] for r in kept.collect()} == {1: 3, 2: 20}
    greedy = spark.createDataFrame([(1, 26), (2, 1)], "query_id long, limit int")
    with pytest.raises(Exception, match="limit above the cut at 25"):
        within_query_limits(ranked, greedy, 25).collect()


def test_pages_for_limit(spark):
    df = spark.createDataFrame([(n,) for n in (-1, 0, 1, 10, 11, 20, 21, 50, 51, 900)], "n int")
    out = [r[0] for r in df.select(pages_for_limit(F.col("n"))).collect()]
    assert out == [2, 2, 1, 1, 2, 2, 3, 5, 5, 5]


def test_union_fills_missing(spark):
    a = hits_of(spark, hit())
    assert union_hits(a, a.drop("thumbnail")).count() == 2


# Requests ------------------------------------------------------------------


def queries_of(spark, *rows):
    schema = "query_id long, query string, engines string, time_range string, " \
             "safesearch int, locale string, limit int"
    return spark.createDataFrame(list(rows), schema)


def test_select_engines(spark):
    rows = queries_of(
        spark,
        (1, "q", None, None, None, None, None),
        (2, "q", " bingnews ,,brave,bingnews", None, None, None, None),
        (3, "q", " , ", None, None, None, None),
    )
    out = select_engines(rows.select("query_id", "engines")).orderBy("query_id", "engine_at")
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append(r["engine"])
    assert got == {1: ["brave", "duckduckgo"], 2: ["bingnews", "brave", "bingnews"], 3: ENGINES}
    with pytest.raises(Exception, match="unknown engine nope"):
        select_engines(queries_of(spark, (1, "q", "nope", None, None, None, None))).collect()


def test_plan_requests(spark):
    rows = queries_of(
        spark,
        (1, "a b!c !g", "brave,duckduckgo,brave-news,bingnews", "week", 1, "de-DE", 11),
        (2, "x" * 500, "duckduckgo,brave", None, None, None, 5),
        (3, "é" * 250, "duckduckgo", None, None, None, 5),
        (4, "é" * 249, "duckduckgo", None, None, None, 5),
    )
    out = {(r["query_id"], r["engine"], r["page"]): r for r in plan_requests(rows).collect()}
    assert len(out) == 8 + 2 + 1 + 1
    assert out[1, "brave", 1]["url"] == (
        "https://search.brave.com/search?q=a+b%21c+%21g&source=web&tf=pw"
    )
    assert out[1, "brave", 2]["url"].endswith("&source=web&offset=1&tf=pw")
    assert out[1, "brave-news", 2]["url"] == "https://search.brave.com/news?q=a+b%21c+%21g&source=web"
    assert out[1, "bingnews", 2]["url"] == (
        "https://www.bing.com/news/infinitescrollajax?q=a+b%21c+%21g&InfiniteScroll=1&first=11"
        '&SFX=1&form=PTFTNR&qft=interval="7"&mkt=de-DE'
    )
    assert out[1, "duckduckgo", 1]["form"] == "b=&df=w&kl=de-de&q=a+b%21c+%27%21g%27"
    assert "&s=10&" in out[1, "duckduckgo", 2]["form"] and "dc=11&" in out[1, "duckduckgo", 2]["form"]
    assert out[1, "brave", 1]["safesearch"] == "moderate"
    assert out[2, "duckduckgo", 1]["error"] == "duckduckgo: query too long (max 499 characters)"
    assert out[2, "duckduckgo", 1]["url"] is None and out[2, "brave", 1]["error"] is None
    assert out[3, "duckduckgo", 1]["error"] is not None
    assert out[4, "duckduckgo", 1]["error"] is None


# Cache ---------------------------------------------------------------------


def page_rows(spark, *rows):
    full = [(k, f"u{k}", f"t{k}", f"h{k}", "s", at) for k, at in rows]
    return spark.createDataFrame(full, PAGE_CACHE)


def keys_of(df):
    return sorted(r["cache_key"] for r in df.collect())


def test_live_and_purge(spark):
    cache = page_rows(spark, ("never", 0), ("equal", 100), ("past", 99), ("later", 101), ("none", None))
    live = ["equal", "later", "never", "none"]
    assert keys_of(C.live_entries(cache, 100)) == live
    assert keys_of(C.purge_expired(cache, 100)) == live
    assert C.purge_all(cache).count() == 0
    assert C.cache_stats(cache, 100).first() == Row(entries=5, expired=1)


def test_upsert_replaces_whole_entries(spark):
    def entry(key, *urls):
        return [(key, n + 1, u, "t", "s", None, None, 0) for n, u in enumerate(urls)]

    old = spark.createDataFrame(entry("a", "1", "2", "3") + entry("b", "4"), RESULT_CACHE)
    new = spark.createDataFrame(entry("a", "9") + entry("c", "5", "6"), RESULT_CACHE)
    out = C.upsert_entries(old, new)
    assert sorted((r["cache_key"], r["url"]) for r in out.collect()) == [
        ("a", "9"), ("b", "4"), ("c", "5"), ("c", "6"),
    ]
    assert C.cache_stats(out, 1, "many").first()["entries"] == 3
    gone = spark.createDataFrame([("c",), ("c",)], "cache_key string")
    assert keys_of(C.delete_entries(out, gone)) == ["a", "b"]


def test_latest_entries(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")],
                                 "cache_key string, v int, url string")
    assert sorted(r["url"] for r in C.latest_entries(rows, "v").collect()) == ["w", "y", "z"]


def test_expiry(spark):
    row = spark.range(1).select(C.expiry(100, 300).alias("a"), C.expiry(100, 0).alias("b")).first()
    assert (row["a"], row["b"]) == (400, 0)


def test_lookup_and_split(spark):
    requests = spark.createDataFrame(
        [(1, "brave", 1, "k1"), (1, "brave", 2, "k2"), (2, "brave", 1, "k3")],
        "query_id long, engine string, page int, cache_key string",
    )
    cache = spark.createDataFrame(
        [("k1", 1, "u1", "t", "s", None, None, 0), ("k1", 2, "u2", "t", "s", None, None, 0),
         ("k2", 1, "old", "t", "s", None, None, 99)], RESULT_CACHE,
    )
    fetched = hits_of(spark, hit(1, page=1, url="never"), hit(1, page=2, url="f2"), hit(2, url="f3"))
    out = C.cached_and_fresh(requests, cache, fetched, 100)
    assert sorted((r["url"], r["cached"]) for r in out.collect()) == [
        ("f2", False), ("f3", False), ("u1", True), ("u2", True),
    ]
    for options in ({"use_cache": False}, {"refresh": True}):
        out = C.cached_and_fresh(requests, cache, fetched, 100, **options)
        assert sorted(r["url"] for r in out.collect()) == ["f2", "f3", "never"]
    answered, missed = C.split_cached(requests, cache, 100)
    assert (keys_of(answered), keys_of(missed)) == (["k1"], ["k2", "k3"])


def test_store_rules(spark):
    pages = spark.createDataFrame(
        [("a", "t", "h", "s", ""), ("b", "t", "h", "s", "bad"), ("c", "t", "", "s", None),
         ("d", "t", "h", "s", None)], SNAPSHOT,
    )
    kept = C.page_entries(pages, F.col("url"), 300, 100)
    assert keys_of(kept) == ["a", "d"] and kept.first()["expires_at"] == 400
    assert C.page_entries(pages, F.col("url"), 300, 100, use_cache=False).count() == 0
    fresh = hits_of(spark, hit(), hit(page=2, cached=True)).withColumn("cache_key", F.lit("k"))
    assert C.result_entries(fresh, 300, 100).count() == 1


# Pages ---------------------------------------------------------------------


def record(url, title="title", error=None, raw_html=None, published_at=None, content_md=None):
    return (url, title, None, 1.0, ["brave"], False, published_at, raw_html, None, content_md, error)


def records_of(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def by_url(df):
    return {r["url"]: r for r in df.collect()}


def test_attach_pages(spark):
    records = records_of(
        spark, record("a"), record("b"), record("c", error="old"), record("", error="kept"),
        record("d", error="old", content_md="c"), record("e"),
    )
    snapshots = spark.createDataFrame(
        [("a", "new", "<a>", "t1", ""), ("b", "", "", "t2", "extract html: x"),
         ("c", "new", "<c>", "t3", None), ("d", "no", "<no>", "t4", "no")], SNAPSHOT,
    )
    cache = spark.createDataFrame([("k", "d", "", "<d>", "t5", 0), ("k", "a", "x", "x", "x", 5)], PAGE_CACHE)
    out = by_url(attach_pages(records, snapshots, cache, now=10))
    assert (out["a"]["title"], out["a"]["raw_html"], out["a"]["error"]) == ("new", "<a>", None)
    assert (out["b"]["title"], out["b"]["raw_html"], out["b"]["error"]) == ("title", None, "extract html: x")
    assert out["c"]["error"] == "old" and out["c"]["scraped_at"] == "t3"
    assert out[""]["error"] == "kept" and out[""]["raw_html"] is None
    assert out["e"]["error"] == NO_SNAPSHOT
    d = out["d"]
    assert (d["title"], d["raw_html"], d["error"], d["content_md"]) == ("", "<d>", "old", "c")
    d = by_url(attach_pages(records, snapshots, cache, now=10, reset_error=True))["d"]
    assert (d["error"], d["content_md"]) == (None, None)


def brute_pick(rows, min_chars=500, window=5000):
    rows = sorted(rows)
    ready = [r for r in rows if r[0] <= window and r[1] >= min_chars]
    inside = [r for r in rows if r[0] <= window]
    if ready or not inside:
        return (ready or rows)[0]
    return min(inside, key=lambda r: (-r[0], -r[1], r[2]))


def test_pick_snapshot(spark):
    rng = random.Random(5)
    groups = {
        f"u{n}": [(rng.randint(0, 9000), rng.randint(0, 900), rng.randint(0, 99)) for _ in range(1 + n % 7)]
        for n in range(40)
    }
    rows = [(u, *r) for u, rs in groups.items() for r in rs]
    captures = spark.createDataFrame(rows, "url string, waited_ms int, text_length int, raw_html int")
    for broadcast_urls in (1000, 0):
        rows = pick_snapshot(captures, broadcast_urls=broadcast_urls).collect()
        assert len(rows) == len(groups)
        assert {r["url"]: tuple(r)[1:] for r in rows} == {u: brute_pick(rs) for u, rs in groups.items()}


def test_pick_snapshot_far_values_nulls_and_copies(spark):
    """Times and lengths beyond the packed ranges, no URL, null measures, repeated rows."""
    day = 86_400_000
    rows = [
        ("far", 40 * day, 1, "c"), ("far", 30 * day, 2, "b"), ("far", 30 * day, 1, "z"),
        ("long", 10, 3_000_000_000, "b"), ("long", 10, 2_000_000_000, "c"), ("long", 10, 2_000_000_000, "a"),
        (None, 20, 900, "n"), (None, 10, 900, "m"), ("same", 10, 900, "x"), ("same", 10, 900, "x"),
        ("null", None, 900, "w"), ("null", 9000, 900, "v"), ("short", 10, None, "u"), ("short", 20, 1, "t"),
    ]
    captures = spark.createDataFrame(rows, "url string, waited_ms long, text_length long, raw_html string")
    want = {"far": "z", "long": "a", None: "m", "same": "x", "null": "w", "short": "t"}
    for broadcast_urls in (1000, 0):
        got = pick_snapshot(captures, broadcast_urls=broadcast_urls).collect()
        assert len(got) == len(want) and {r.url: r.raw_html for r in got} == want
    assert pick_snapshot(captures.limit(0)).collect() == []


# Sanitize ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title>
<meta content="2024-05-06T10:00:00Z" property="article:published_time"></head>
<body><nav>menu</nav><script>var t="</p><article>";</script><!-- <article>no</article> -->
<article><h1>Head</h1><p>One <a href="https://x/">link</a><br>two&nbsp; &lt;b&gt;
<table><tr><td>1</td><td>2</td></tr></table><div class="wide ad">buy</div><p>End.</article>
<footer>foot</footer></body></html>"""


def test_main_text(spark):
    df = spark.createDataFrame([(PAGE,)], "h string")
    assert df.select(main_text(F.col("h"))).first()[0] == "Head\nOne link\ntwo <b>\n1 2\nEnd."
    linked = df.select(main_text(F.col("h"), links=True)).first()[0]
    assert "[link](https://x/)" in linked
    meta = df.select(page_metadata(F.col("h")).alias("m")).first()["m"]
    assert tuple(meta) == ("A & B", "2024-05-06T00:00:00Z")


def test_text_outside_an_article(spark):
    html = "<h1>Hello</h1><p>World</p>"
    assert spark.createDataFrame([(html,)], "h string").select(main_text(F.col("h"))).first()[0] == "Hello\nWorld"


def test_sanitize_html(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "<p>x</p>")], "i int, h string")
    out = [r["s"] for r in df.select("i", sanitize_html(F.col("h")).alias("s")).orderBy("i").collect()]
    assert [o["error"] for o in out] == ["no raw HTML to sanitize"] * 2 + [None]
    assert out[2]["content_md"] == "x"
    failing = df.select(sanitize_html(F.col("h"), extractor=lambda c: F.lit(None).cast("string")).alias("s"))
    assert failing.orderBy("i").collect()[2]["s"]["error"] == "sanitize: no content"


def test_sanitize_records(spark):
    records = records_of(
        spark, record("ok", raw_html="<p>processed</p>"),
        record("error", raw_html="<p>x</p>", error="prev error"),
        record("empty", raw_html=""), record("none"),
        record("dated", raw_html=PAGE, published_at="2020-01-01T00:00:00Z"), record("undated", raw_html=PAGE),
    )
    out = by_url(sanitize(records, strip="sanitized"))
    assert out["ok"]["content_md"] == "processed" and out["ok"]["raw_html"] is None
    assert (out["error"]["error"], out["error"]["content_md"]) == ("prev error", None)
    assert out["error"]["raw_html"] == "<p>x</p>"
    assert out["empty"]["content_md"] is None and out["empty"]["error"] is None
    assert out["dated"]["published_at"] == "2020-01-01T00:00:00Z"
    assert out["undated"]["published_at"] == "2024-05-06T00:00:00Z"
    assert out["undated"]["title"] == "title" and out["undated"]["extracted_title"] == "A & B"
    assert {r["raw_html"] for r in sanitize(records).collect()} == {None}
    assert by_url(sanitize(records, strip="none"))["ok"]["raw_html"] == "<p>processed</p>"
    assert len(by_url(sanitize(records, 4))["ok"]["content_md"]) == 4
    assert {r["raw_html"] for r in strip_html(records).collect()} == {None}
    custom = sanitize(records, extractor=lambda html: F.upper(html))
    assert by_url(custom)["ok"]["content_md"] == "<P>PROCESSED</P>"


# Records and status --------------------------------------------------------


def test_to_records_and_json(spark):
    rows = hits_of(
        spark, hit(url="https://a/", snippet="", published=dt.datetime(2026, 3, 15, 1, 2, 3)),
        hit(position=2, url="https://b/", title='q"uote'),
    )
    records = to_records(rank_results(merge_hits(rows)), "query_id", "rank")
    out = json.loads(results_json(records).first()["results"])
    assert [list(o) for o in out] == [
        ["url", "title", "snippet", "score", "engines", "cached", "published_at", "scraped_at",
         "content_md", "error"]
    ] * 2
    assert out[0]["snippet"] is None and out[0]["published_at"] == "2026-03-15T01:02:03Z"
    assert out[1]["title"] == 'q"uote' and out[1]["engines"] == ["brave"]


def test_result_cards(spark):
    rows = [
        (1, "https://a/", "T" * 100, "s", 2.5, ["brave", "bingnews"], True, "2026-03-15T23:00:00Z", "boom"),
        (2, "https://b/", "t", None, 0.0, [], False, "not a date", None),
    ]
    schema = "rank int, url string, title string, snippet string, score double, " \
             "engines array<string>, cached boolean, published_at string, error string"
    cards = [r["card"] for r in result_cards(spark.createDataFrame(rows, schema)).orderBy("rank").collect()]
    assert cards[0] == (
        "[1] " + "T" * 71 + "...\n    https://a/\n    s\n"
        "    ── brave · 2026-03-15 · cached · score: 2.50 · 2 engines · error: boom ──\n"
    )
    assert cards[1] == "[2] t\n    https://b/\n    ── - ──\n"


def test_status(spark):
    codes = [(1, 200, None), (1, 429, "30"), (1, 429, "soon"), (1, 403, None), (1, 503, None),
             (1, 404, None), (2, None, None), (2, None, None), (3, 200, None)]
    probes = spark.createDataFrame(codes, "run_id int, http_status int, retry_after string")
    rows = classify_status(probes).collect()
    assert [r["severity"] for r in rows] == ["ok", "warn", "warn", "fail", "warn", "warn", "fail", "fail", "ok"]
    assert rows[1]["tip"] == "Too many requests: wait 30 s."
    assert rows[2]["tip"] == "Too many requests: wait 60 s."
    assert classify_status(probes, verbose=True).collect()[5]["tip"] == "HTTP 404 is neither an answer nor a known refusal."
    out = {r["run_id"]: r for r in health_summary(classify_status(probes)).collect()}
    assert out[1]["summary"] == "1 failed, 4 warned" and not out[1]["all_unreachable"]
    assert out[2]["all_unreachable"] and out[3]["summary"] == "nothing failed"


def test_upsert_keeps_one_page_per_key(spark):
    schema = "cache_key string, url string, title string, expires_at long"
    old = spark.createDataFrame([("a", "u", "old", 5), ("b", "v", "kept", 5)], schema)
    new = spark.createDataFrame([("a", "u", "new", 9), ("a", "u", "newer", 12), ("a", "u", "newer", 12)], schema)
    got = sorted(tuple(r) for r in C.upsert_entries(old, new, rows_per_entry="one").collect())
    assert got == [("a", "u", "newer", 12), ("b", "v", "kept", 5)]
    with pytest.raises(ValueError):
        C.upsert_entries(old, new, rows_per_entry="some")


def test_one_answer_per_record(spark):
    """Several captures of a URL, a record without URL: each record stays one row."""
    records = spark.createDataFrame(
        [("u", "t"), (None, "none"), ("", "empty"), ("w", "miss")], "url string, title string"
    ).selectExpr("*", *[f"cast(null as string) {c}" for c in ("raw_html", "scraped_at", "content_md", "error")])
    pages = spark.createDataFrame(
        [("u", "first", "<p>1</p>", "2024-01-01", None), ("u", "last", "<p>2</p>", "2024-01-02", None), ("u", "last", "<p>2</p>", "2024-01-02", None)],
        "url string, title string, raw_html string, scraped_at string, error string",
    )
    got = {r["url"]: r for r in attach_pages(records, pages).collect()}
    assert len(got) == 4 and attach_pages(records, pages).count() == 4
    assert (got["u"]["title"], got["u"]["raw_html"]) == ("last", "<p>2</p>")
    assert got["w"]["error"] == NO_SNAPSHOT and got[None]["error"] is None and got[""]["title"] == "empty"
