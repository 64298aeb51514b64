"""Result pages to ranked hits: page status, extraction, filters, numbering."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.functions.dates import parse_result_date, strip_date_prefix, utc_now
from hitloom.functions.lookups import literal_map
from hitloom.functions.text import trim_space
from hitloom.functions.urls import absolute_url, url_host
from hitloom.operators.html_hits import page_hits
from hitloom.operators.rules import DEFAULT_RULES
from hitloom.schemas import TEXT, TEXTS, struct

RAW_HITS = T.ArrayType(
    struct(
        url=TEXT, title=TEXT, snippet=TEXT, thumbnail=TEXT, date_text=TEXT, classes=TEXTS
    )
)

ARROW_HITS = pa.list_(
    pa.struct(
        [(f, pa.string()) for f in ("url", "title", "snippet", "thumbnail", "date_text")]
        + [("classes", pa.list_(pa.string()))]
    )
)

PAGE = ["query_id", "engine", "page"]
CHALLENGE_FORM = r"(?is)<form\b[^>]*\bid\s*=\s*[\"']?challenge-form[\"'\s>]"


def page_status(result_pages: DataFrame) -> DataFrame:
    """Add ``status`` (ok, empty, failed) with ``error_kind`` and ``error``.

    A status other than 200 fails; a 303 from duckduckgo is an empty page without
    an error, and a challenge form there is a captcha error.
    """
    engine, code = F.col("engine"), F.col("http_status")
    ddg = engine == "duckduckgo"
    captcha = ddg & F.col("html").rlike(CHALLENGE_FORM)
    family = F.when(engine == "brave-news", F.lit("brave")).otherwise(engine)
    kind = (
        F.when(ddg & (code == 303), F.lit(None).cast("string"))
        .when(code != 200, F.lit("http"))
        .when(captcha, F.lit("captcha"))
    )
    error = F.when(
        F.col("error_kind") == "http",
        F.concat(family, F.lit(": HTTP "), code.cast("string")),
    ).when(
        F.col("error_kind") == "captcha",
        F.concat(engine, F.lit(": captcha challenge detected")),
    )
    status = (
        F.when(F.col("error_kind").isNotNull(), F.lit("failed"))
        .when(code != 200, F.lit("empty"))
        .otherwise("ok")
    )
    return (
        result_pages.withColumn("error_kind", kind)
        .withColumn("error", error)
        .withColumn("status", status)
    )


def warnings(result_pages: DataFrame) -> DataFrame:
    """The failed pages: a page that fails never fails its query."""
    return (
        page_status(result_pages)
        .filter(F.col("status") == "failed")
        .select("query_id", "engine", "page", "error_kind", "error")
    )


def search_warnings(requests: DataFrame, result_pages: DataFrame) -> DataFrame:
    """What a search could not answer: (query_id, engine, page, error_kind, error).

    ``requests`` is the plan (see ``plan_requests``). A request that was refused
    (``query``), one whose page failed (``http``, ``captcha``) and one that no capture
    answers (``absent``) each give a row; pages nobody asked for give none.
    """
    keys = ["query_id", "engine", "page"]
    refused = requests.filter(F.col("error").isNotNull()).select(
        *keys, F.lit("query").alias("error_kind"), "error"
    )
    asked = requests.filter(F.col("error").isNull()).select(*keys).distinct()
    captured = page_status(result_pages).select(*keys, "status", "error_kind", "error")
    return refused.unionByName(unanswered(asked, captured))


def unanswered(asked: DataFrame, captured: DataFrame) -> DataFrame:
    """Warnings of the requests asked, given the status of the captured pages."""
    columns = [*PAGE, "error_kind", "error"]
    failed = captured.filter(F.col("status") == "failed").select(*columns).join(asked.select(*PAGE), PAGE, "left_semi")
    absent = asked.select(*PAGE).join(captured.select(*PAGE), PAGE, "left_anti").select(
        *PAGE,
        F.lit("absent").alias("error_kind"),
        F.concat("engine", F.lit(": no capture")).alias("error"),
    )
    return failed.unionByName(absent)


def raw_hits(html: Column, engine: Column, rules=DEFAULT_RULES) -> Column:
    """Array of the hit containers of one page: the one step that leaves the JVM."""
    by_name = {r.name: r for r in rules}

    @F.arrow_udf(RAW_HITS)
    def parse(html: pa.Array, engine: pa.Array) -> pa.Array:
        rows = zip(html.to_pylist(), engine.to_pylist())
        return pa.array([page_hits(h, by_name.get(e)) for h, e in rows], ARROW_HITS)

    return parse(html, engine)


def _by_engine(rules, field: str) -> Column:
    values = {r.name: getattr(r, field) for r in rules}
    return F.try_element_at(literal_map(values), F.col("engine"))


def parsed_pages(result_pages: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """One row per page: its status with ``error_kind`` and ``error``, and its hit containers.

    The one costly pass: stored, it gives the hits and the warnings without the HTML.
    """
    html = F.when(F.col("status") == "ok", F.col("html"))
    return page_status(result_pages).select(
        *PAGE, "status", "error_kind", "error", raw_hits(html, F.col("engine"), rules).alias("raw")
    )


def extract_hits(
    result_pages: DataFrame,
    rules=DEFAULT_RULES,
    as_of: Column | None = None,
    date_mode: str = "chars",
) -> DataFrame:
    """Hits of all pages that loaded, numbered from 1 within each page."""
    loaded = page_status(result_pages).filter(F.col("status") == "ok")
    raw = loaded.select(*PAGE, raw_hits(F.col("html"), F.col("engine"), rules).alias("raw"))
    return hits_of(raw, rules, as_of, date_mode)


def hits_of(
    parsed: DataFrame,
    rules=DEFAULT_RULES,
    as_of: Column | None = None,
    date_mode: str = "chars",
) -> DataFrame:
    """Hits of parsed pages (query_id, engine, page, raw), numbered from 1 within each page.

    The kept hits of a page stay one array until they are numbered, so the position
    comes from ``posexplode`` and nothing is shuffled.
    """
    keys, raw = PAGE, parsed
    need_host, skip = _by_engine(rules, "require_host"), _by_engine(rules, "skip_class")

    def keep(h: Column) -> Column:
        has_host = ~need_host | (F.coalesce(url_host(h["url"]), F.lit("")) != "")
        return (h["url"] != "") & has_host & ~F.array_contains(h["classes"], skip)

    hits = raw.select(*keys, F.posexplode(F.filter("raw", keep)).alias("at", "h"))
    texts = hits.select(
        *keys,
        (F.col("at") + 1).cast("int").alias("position"),
        F.col("h.url").alias("url"),
        trim_space(F.col("h.title")).alias("title"),
        trim_space(F.col("h.snippet")).alias("snippet"),
        absolute_url(F.col("h.thumbnail"), _by_engine(rules, "origin")).alias("thumbnail"),
        trim_space(F.col("h.date_text")).alias("date_text"),
    )
    now = utc_now() if as_of is None else as_of
    dated = texts.withColumn("published", parse_result_date(F.col("date_text"), now))
    snippet = strip_date_prefix(
        F.col("snippet"), F.col("date_text"), F.col("published"), date_mode
    )
    return dated.select(
        *keys,
        "position",
        "url",
        "title",
        snippet.alias("snippet"),
        F.nullif(F.col("thumbnail"), F.lit("")).alias("thumbnail"),
        "published",
        F.lit(False).alias("cached"),
    )
