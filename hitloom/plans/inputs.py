"""Input tables of the registered queries, derived from the given tables.

Every row of the given table takes part; each derivation is a projection (with an
explode), so it costs no shuffle and grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.functions.html import TITLE
from hitloom.functions.keys import page_key, result_key
from hitloom.operators.extract import extract_hits
from hitloom.operators.requests import plan_requests
from hitloom.schemas import RECORD

NOW = 1_700_000_000
QUEUED = 1_706_745_600  # 2024-02-01T00:00:00Z
AS_OF = "2026-03-31 12:30:15"
ENGINES = ["brave", "duckduckgo", "brave-news", "bingnews"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(index: Column, values: list) -> Column:
    """The value at ``index`` modulo their number."""
    return F.get(F.lit(values), F.pmod(index, F.lit(len(values))).cast("int"))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def paragraphs(html: Column) -> Column:
    """Texts of all paragraphs of the article, closed or not, without inner tags; entities stay."""
    body = F.regexp_extract(html, r"(?s)<article>(.*)</article>", 1)
    parts = F.slice(F.split(body, "<p>"), 2, 2_000_000_000)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "<[^<>]*>", "")), lambda x: x != "")


def pages_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their title and all their paragraphs."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("html", TITLE, 1).alias("title"),
        paragraphs(F.col("html")).alias("paragraphs"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit per paragraph of a page, sixteen at least, eight of them in a query.

    A query holds hits of neighbouring pages, each in several spellings of its URL;
    (engine, page, position) is unique within a query.
    """
    i, p = F.col("i"), F.col("page_id")
    rows = pages_with_parts(spark, sf_dir).select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("paragraphs"), F.lit(16)) - 1)).alias("i")
    )
    late = F.floor(i / 8)
    rows = rows.withColumn("slot", late * 96 + (p % 12) * 8 + i % 8)
    slot = F.col("slot")
    plain = F.contains("url", F.lit("?")) | F.contains("url", F.lit("#"))
    url = F.col("url")
    spelling = (
        F.when(i % 6 == 1, F.concat(url, F.lit("#s"), i.cast("string")))
        .when(i % 6 == 2, F.replace(url, F.lit("://"), F.lit("://WWW.")))
        .when((i % 6 == 3) & ~plain, F.concat(url, F.lit("/")))
        .when(i % 6 == 4, F.replace(url, F.lit("example"), F.lit("EXAMPLE")))
        .when(i % 6 == 5, F.replace(url, F.lit("http://"), F.lit("https://")))
        .otherwise(url)
    )
    n = F.size("paragraphs")
    snippet = F.when(n > 0, F.get("paragraphs", (i % n).cast("int"))).otherwise("")
    hours = (p * 7 + i).cast("int")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        (F.floor(p / 12) + late).alias("query_id"),
        choose(slot, ENGINES).alias("engine"),
        (F.floor(slot / 4) % 5 + 1).cast("int").alias("page"),
        (F.floor(slot / 20) + 1).cast("int").alias("position"),
        spelling.alias("url"),
        F.concat(F.col("title"), F.repeat(F.lit(" *"), ((p + i * 7) % 5).cast("int"))).alias(
            "title"
        ),
        snippet.alias("snippet"),
        F.when(
            i % 2 == 0,
            F.concat(
                F.lit("https://img.example.com/"), p.cast("string"), F.lit("/"),
                i.cast("string"), F.lit(".png"),
            ),
        ).alias("thumbnail"),
        (start + F.make_dt_interval(hours=hours)).alias("published"),
        F.lit(False).alias("cached"),
    )


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result page per given page and engine, a container per paragraph and three at least, as HTML.

    Five given pages make the five result pages of a query. The second container
    has no usable URL (an advertisement at duckduckgo), the fourth none at all; the others
    after the first repeat across neighbouring pages. Some pages failed, some show a challenge form.
    """
    p = F.col("page_id")
    missing = F.greatest(F.lit(3) - F.size("paragraphs"), F.lit(0))
    source = pages_with_parts(spark, sf_dir).select(
        "page_id",
        F.replace("url", F.lit("&"), F.lit("&amp;")).alias("url"),
        "title",
        F.concat("paragraphs", F.array_repeat(F.lit(""), missing)).alias("texts"),
        F.concat(
            F.lit("https://www.mirror.example.org/"),
            F.floor(p / 2).cast("string"), F.lit("/"),
        ).alias("mirror"),
        choose(p, ["Mar 15, 2026", "3 hours ago", "sponsored"]).alias("date"),
        F.posexplode(F.array(*[F.lit(e) for e in ENGINES])).alias("e", "engine"),
    )
    t, d = F.col("title"), F.col("date")
    lit = F.lit

    def target(n):
        return (
            F.when(n == 1, F.col("url")).when(n == 2, "not-a-valid-url").when(n == 3, F.col("mirror"))
            .when(n == 4, "").otherwise(F.concat("mirror", n.cast("string"), lit("/")))
        )

    def brave(n, x):
        thumb = F.concat(
            lit('<a class="thumbnail"><img src="https://img.example.com/'),
            p.cast("string"), lit('.png"></a>'),
        )
        return F.concat(
            lit('<div class="snippet fdb"><a href="'), target(n), lit('">link</a><div class="title"> '),
            t, lit(" "), n.cast("string"), lit('\n</div><span class="t-secondary"> '), d,
            lit('</span><div class="content">'), d, lit(" - <b>"), x, lit("</b></div>"),
            F.when(n == 1, thumb).otherwise(""), lit("</div>\n"),
        )

    def duckduckgo(n, x):
        return F.concat(
            lit('<div class="web-result'), F.when(n == 2, " result--ad").otherwise(""), lit('"><h2><a href="'),
            target(n), lit('">'), t, lit(" "), n.cast("string"), lit('</a></h2><a class="result__snippet">'),
            x, lit("</a></div>\n"),
        )

    def brave_news(n, x):
        return F.concat(
            lit('<div data-type="news"><a class="result-header" href="'), target(n),
            lit('">x</a><span class="snippet-title">'), t, lit(" "), n.cast("string"), lit('</span><p class="desc">'),
            x, lit('<div class="image-wrapper"><img src="https://img.example.com/n/'),
            p.cast("string"), lit('.jpg"/></div></div>\n'),
        )

    def bingnews(n, x):
        return F.concat(
            lit('<div class="newsitem"><a class="title" href="'), target(n), lit('">'), t, lit(" "), n.cast("string"),
            lit('</a><div class="snippet">'), x,
            lit('</div><a class="imagelink"><img src="/th?id='), p.cast("string"),
            lit('"></a></div>\n'),
        )

    def body(render):
        return F.array_join(F.transform("texts", lambda x, i: render(i + 1, x)), "")

    challenge = (F.col("engine") == "duckduckgo") & (p % 13 == 0)
    html = F.concat(
        lit("<!DOCTYPE html><html><head><title>results</title></head><body>"),
        F.when(challenge, '<form id="challenge-form"></form>').otherwise(""),
        F.when(F.col("engine") == "brave", body(brave))
        .when(
            F.col("engine") == "duckduckgo",
            F.concat(lit('<div id="links">'), body(duckduckgo), lit("</div>")),
        )
        .when(F.col("engine") == "brave-news", body(brave_news))
        .otherwise(body(bingnews)),
        lit("</body></html>"),
    )
    status = (
        F.when((p + F.col("e")) % 11 == 0, 429).when((p + F.col("e")) % 11 == 1, 303).otherwise(200)
    )
    return source.select(
        F.floor(p / 5).alias("query_id"),
        "engine",
        (p % 5 + 1).cast("int").alias("page"),
        status.alias("http_status"),
        html.alias("html"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captured bodies; every tenth failed, every fifteenth is empty."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "url",
        F.when(p % 4 == 0, "").otherwise(F.regexp_extract("html", TITLE, 1)).alias("title"),
        F.when((p % 10 == 0) | (p % 15 == 0), "").otherwise(F.col("html")).alias("raw_html"),
        F.concat(F.lit("2024-02-01T00:00:"), F.lpad((p % 60).cast("string"), 2, "0"), F.lit("Z"))
        .alias("scraped_at"),
        F.when(p % 10 == 0, F.lit("navigate: timeout")).otherwise("").alias("error"),
    )


def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as page-cache rows; every seventh never expires, others around NOW."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        page_key(F.col("url")).alias("cache_key"),
        "url",
        F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("cached "), p.cast("string"))).alias("title"),
        F.col("html").alias("raw_html"),
        F.lit("2024-01-31T00:00:00Z").alias("scraped_at"),
        F.when(p % 7 == 0, F.lit(0)).otherwise(F.lit(NOW) + p % 5 - 2).cast("bigint").alias("expires_at"),
    )


def request_key() -> Column:
    query = F.concat(F.lit("query "), F.col("query_id").cast("string"))
    return result_key(
        F.col("engine"), query, F.lit(""), F.lit(0), F.lit("en-US"), F.col("page")
    )


def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits as result-cache rows; the age of an entry follows from its query and page."""
    age = F.col("query_id") + F.col("page")
    expires = F.when(age % 7 == 0, F.lit(0)).otherwise(F.lit(NOW) + age % 5 - 2)
    return hits(spark, sf_dir).select(
        request_key().alias("cache_key"), "position", "url", "title", "snippet", "thumbnail",
        "published", expires.cast("bigint").alias("expires_at"),
    )


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per event."""
    e = F.col("event_id")
    text = F.concat(
        F.when(e % 5 == 0, "!g ").otherwise(""), F.col("event_type"), F.lit(" "),
        F.col("props"), F.when(e % 3 == 0, " !wiki~ü*").otherwise(""),
    )
    return table(spark, sf_dir, "events").select(
        e.alias("query_id"),
        F.when(e % 97 == 0, F.repeat(F.concat("event_type", F.lit(" ")), 100)).otherwise(text).alias("query"),
        choose(e, ["", "brave, duckduckgo", "bingnews,, brave-news ,bingnews", " , "]).alias("engines"),
        choose(e, ["day", "week", "month", "year", "", "bogus"]).alias("time_range"),
        choose(e, ["", "en-US", "de-DE", "zh-TW", "zz-ZZ"]).alias("locale"),
        (e % 4).cast("int").alias("safesearch"),
        (e % 70).cast("int").alias("limit"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three engine probes per run, one per event; runs whose number divides by 50 got no answer."""
    e = F.col("event_id")
    code = choose(e, [200, 429, 403, 500, 200, 503, 404, 200, 429])
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.floor(e / 3).alias("run_id"),
        F.when(F.floor(e / 3) % 50 == 0, F.lit(None)).otherwise(code).cast("int").alias("http_status"),
        F.nullif(choose(F.floor(e / 2), ["30", "soon", ""]), F.lit("")).alias("retry_after"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture of a user's page per event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://example.com/u/"), F.col("user_id").cast("string")).alias("url"),
        ((e * 379) % 9001 + F.when(F.col("user_id") % 3 == 0, 6000).otherwise(0)).alias("waited_ms"),
        ((e * 131) % 1200).alias("text_length"),
        "event_id",
        F.concat(F.lit("<p>"), "event_type", F.lit(" "), "props", F.lit("</p>")).alias("raw_html"),
    )


def waiting_records(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    """Ranked records with an id and the second they were queued at, which follows from their query."""
    return records.select(
        *RECORD.fieldNames(),
        F.concat_ws(":", F.col("query_id").cast("string"), F.col("rank").cast("string")).alias("record_id"),
        F.timestamp_seconds(F.lit(QUEUED) + F.col("query_id") % 60).alias("queued_at"),
    )


def late_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots, and of every third page a second capture twenty seconds later; ``late`` ones arrive after the rest."""
    p = F.col("page_id")
    first = snapshots(spark, sf_dir).withColumn("late", F.right("scraped_at", F.lit(2)) >= "5Z")
    again = table(spark, sf_dir, "pages").where(p % 3 == 0).select(
        "url",
        F.concat(F.lit("again "), p.cast("string")).alias("title"),
        F.col("html").alias("raw_html"),
        F.concat(
            F.lit("2024-02-01T00:0"), F.floor((p % 60 + 20) / 60).cast("string"), F.lit(":"),
            F.lpad(((p + 20) % 60).cast("string"), 2, "0"), F.lit("Z"),
        ).alias("scraped_at"),
        F.lit("").alias("error"),
        F.lit(True).alias("late"),
    )
    return first.unionByName(again)


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as scraped records; some in error, some without a body or a URL, some that tell their date."""
    p = F.col("page_id")
    dated = F.replace("html", F.lit("</head>"), F.lit('<meta name="date" content="2024-03-04"></head>'))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(p % 17 == 0, "").otherwise(F.col("url")).alias("url"),
        F.regexp_extract("html", TITLE, 1).alias("title"),
        F.when(p % 6 == 0, none).otherwise(F.concat(F.lit("page "), p.cast("string"))).alias("snippet"),
        (p % 9 / 4).alias("score"),
        F.when(p % 2 == 0, F.array(F.lit("brave"))).otherwise(
            F.array(F.lit("brave"), F.lit("bingnews"))
        ).alias("engines"),
        (p % 8 == 0).alias("cached"),
        F.when(p % 3 == 0, "2024-05-06T07:08:09Z").alias("published_at"),
        F.when(p % 12 == 0, none).when(p % 4 == 1, dated).otherwise(F.col("html")).alias("raw_html"),
        F.lit("2024-02-01T00:00:00Z").alias("scraped_at"),
        none.alias("content_md"),
        F.when(p % 10 == 0, "navigate: timeout").alias("error"),
    )


def structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a nested menu, a table, a list, a quote and a second article put in, some tags left open."""
    p = F.col("page_id").cast("string")
    link = F.concat(F.lit('<a href="/p?id='), p, F.lit('&amp;x=1">page '), p, F.lit("</a>"))
    home = F.concat(F.lit("<a href='"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("'>home</a>"))
    more = F.concat(
        F.lit("<nav><div><nav>in</nav>tail menu</div></nav><!-- <p>no</p> -->"),
        F.lit("<table><tr><th>Name</th><th title='a > b'>No</th></tr><tr><td>"), link,
        F.lit("<td>"), (F.col("page_id") * 3).cast("string"), F.lit("</table><ul><li>one "), p,
        F.lit("<li>two "), home, F.lit(" end</ul><div><form><label>skip</div><aside><p>skip</aside>"),
        F.lit("<blockquote>quoted</blockquote></article><p>between</p><article><p>second &lt;part&gt;</p></article>"),
    )
    html = F.replace("html", F.lit("</article>"), more)
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


def page_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries whose answers ``result_pages`` holds; each has its limit, some are too long for one engine."""
    q = F.col("query_id")
    ids = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).alias("query_id")).distinct()
    return ids.select(
        "query_id",
        F.concat(F.lit("query "), q.cast("string"), F.when(q % 9 == 4, F.repeat(F.lit(" long"), 100)).otherwise("")).alias("query"),
        F.lit(",".join(ENGINES)).alias("engines"),
        (q * 7 % 51).cast("int").alias("limit"),
    )


def answered_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result cache for the plan of ``page_queries``: a third of them live, a third expired, a third absent."""
    asked = plan_requests(page_queries(spark, sf_dir)).select("query_id", "engine", "page", "cache_key")
    q = F.col("query_id")
    hits = extract_hits(result_pages(spark, sf_dir), as_of=as_of()).where(q % 3 < 2).join(asked, ["query_id", "engine", "page"])
    return hits.select(
        "cache_key", "position", "url", F.concat("title", F.lit(" (kept)")).alias("title"), "snippet", "thumbnail",
        "published", F.when(q % 3 == 0, NOW + 5).otherwise(NOW - 5).cast("bigint").alias("expires_at"),
    )
