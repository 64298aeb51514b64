"""Whole plans: search, and search with page text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.html import sanitize_html
from hitloom.functions.keys import page_key
from hitloom.operators.attach import apply_page, latest_page, url_join_key
from hitloom.operators.cache import (
    DEFAULT_TTL,
    cached_and_fresh,
    live_entries,
    met_requests,
    page_entries,
    result_entries,
)
from hitloom.operators.extract import PAGE, extract_hits, hits_of, parsed_pages, unanswered
from hitloom.operators.merge import (
    DEFAULT_LIMIT,
    merge_hits,
    rank_results,
    within_page_limit,
    within_query_limits,
)
from hitloom.operators.records import to_records
from hitloom.operators.requests import plan_requests
from hitloom.operators.rules import DEFAULT_RULES, engine_names
from hitloom.operators.sanitize import MAX_CHARS, apply_sanitized
from hitloom.session import scratch_dir

WANTED_ROWS = 200_000


def search_hits(
    hits: DataFrame, limit: int = DEFAULT_LIMIT, engines=None, total: str = "recount"
) -> DataFrame:
    """Hits to ranked records with query_id, rank and total."""
    asked = within_page_limit(hits, limit)
    ranked = rank_results(merge_hits(asked, engines), limit, total)
    keys = [c for c in ("query_id", "rank", "total") if c in ranked.columns]
    return to_records(ranked, *keys)


def search_pages(
    result_pages: DataFrame, limit: int = DEFAULT_LIMIT, rules=DEFAULT_RULES,
    as_of: Column | None = None,
) -> DataFrame:
    """Result pages to ranked records; pages beyond the limit are never parsed.

    The total is taken in the same pass, so each page is parsed once.
    """
    asked = within_page_limit(result_pages, limit)
    hits = extract_hits(asked, rules, as_of)
    return search_hits(hits, limit, engine_names(rules), total="salted")


def search_cached(
    requests: DataFrame, cache: DataFrame, fetched: DataFrame, limit: int = DEFAULT_LIMIT,
    engines=None, now: int | Column | None = None, use_cache: bool = True,
    refresh: bool = False,
) -> DataFrame:
    """Planned requests to ranked records, from the cache where it answers.

    ``fetched`` holds the hits of captured pages; only those of unanswered requests
    take part. The total is taken in the same pass as the ranking.
    """
    hits = cached_and_fresh(requests, cache, fetched, now, use_cache, refresh)
    return search_hits(hits, limit, engines, total="salted")


def _checked(small: DataFrame) -> DataFrame:
    """``small`` with a hint to broadcast it, if it has at most ``WANTED_ROWS`` rows."""
    return F.broadcast(small) if small.limit(WANTED_ROWS + 1).count() <= WANTED_ROWS else small


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read again."""
    path = scratch_dir(rows.sparkSession, name)
    schema = rows.schema
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _wanted_pages(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshots that a record wants.

    Up to ``WANTED_ROWS`` URLs are counted and broadcast, so the crawl is filtered where it
    is read; more of them meet the crawl in a shuffled (or bucketed) semi-join.
    """
    return snapshots.join(_checked(_wanted_urls(records)), "url", "left_semi")


def _wanted_urls(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce(F.col("url"), F.lit("")) != "").select("url").distinct()


def attach_text(
    records: DataFrame, snapshots: DataFrame, max_chars: int = MAX_CHARS,
    keep_raw: bool = False, extractor=None, unit: str = "bytes",
    cached: DataFrame | None = None,
) -> DataFrame:
    """Records with the text of their pages.

    Only the bodies that a record wants are extracted: a semi-join with the wanted URLs
    stands between the crawl and the extraction. Of several captures of a URL the one
    scraped last counts. What travels to the join is the cut text, and of the body a
    one-character mark that there was one (the body itself only with ``keep_raw``).
    ``records`` are stored first, as both the wanted URLs and the answer come from them.
    Pages of ``cached`` (live rows of a page cache) win over snapshots of their URL.
    """
    return _attach_stored(_stored(records, "records"), snapshots, max_chars, keep_raw, extractor, unit, cached)


def _attach_stored(
    records: DataFrame, snapshots: DataFrame, max_chars: int, keep_raw: bool, extractor, unit: str,
    cached: DataFrame | None = None,
) -> DataFrame:
    snapshots = _wanted_pages(records, snapshots).withColumn("_kept", F.lit(False))
    if cached is not None:
        kept = _wanted_pages(records, cached).withColumn("error", F.lit(None).cast("string"))
        snapshots = snapshots.unionByName(kept.withColumn("_kept", F.lit(True)), allowMissingColumns=True)
    body = F.col("raw_html")
    mark = F.when(F.coalesce(body, F.lit("")) != "", F.lit("x"))
    pages = snapshots.select(
        F.col("url").alias("_key"),
        F.struct(
            "title", (body if keep_raw else mark).alias("raw_html"), "scraped_at", "error",
            F.col("_kept").alias("from_cache"),
        ).alias("_page"),
        sanitize_html(body, max_chars, extractor, unit).alias("_text"),
    )
    pages = latest_page(pages, F.col("_page"), F.col("_text"), prefer=F.col("_page.from_cache"))
    joined = records.withColumn("_key", url_join_key(records.columns)).join(
        pages, "_key", "left"
    )
    scraped = apply_page(joined, [*records.columns, "_text"], reset_error=False)
    out = apply_sanitized(scraped, F.col("_text"), "none" if keep_raw else "all")
    return out.drop("_text")


def run_search(
    result_pages: DataFrame, snapshots: DataFrame, limit: int = DEFAULT_LIMIT,
    rules=DEFAULT_RULES, as_of: Column | None = None, max_chars: int = MAX_CHARS,
    keep_raw: bool = False, extractor=None, unit: str = "bytes",
    queries: DataFrame | None = None,
) -> DataFrame:
    """Result pages and page snapshots to ranked records with text.

    With ``queries`` (query_id, limit; null or not positive: the default) each query has
    its own limit instead of ``limit``: pages, totals and ranks follow it, and pages of
    other queries take no part.

    The ranked records, which are few, are stored in the shared folder, so that result
    pages are parsed once though both the wanted URLs and the answer come from them.
    """
    if queries is not None:
        own = F.when(F.col("limit") > 0, F.col("limit")).otherwise(DEFAULT_LIMIT)
        limits = queries.select("query_id", own.alias("limit"))
        limit = limits.agg(F.max("limit")).first()[0] or DEFAULT_LIMIT
        asked = result_pages.join(_checked(limits.withColumnRenamed("limit", "_own")), "query_id")
        result_pages = within_page_limit(asked, F.col("_own")).drop("_own")
    ranked = search_pages(result_pages, limit, rules, as_of)
    if queries is not None:
        ranked = within_query_limits(ranked, limits, limit)
    return attach_text(ranked, snapshots, max_chars, keep_raw, extractor, unit)


class Answer(NamedTuple):
    """What a search gives: the records, what to put into the two caches, and the warnings."""

    records: DataFrame
    result_entries: DataFrame
    page_entries: DataFrame
    warnings: DataFrame


def answer_queries(
    queries: DataFrame, result_pages: DataFrame, snapshots: DataFrame,
    result_cache: DataFrame, page_cache: DataFrame, now: int,
    ttl: int = DEFAULT_TTL, use_cache: bool = True, refresh: bool = False,
    rules=DEFAULT_RULES, as_of: Column | None = None, max_chars: int = MAX_CHARS,
    keep_raw: bool = False, extractor=None, unit: str = "bytes",
) -> Answer:
    """The whole plan of a table of queries, with both caches.

    ``queries`` as for ``plan_requests``; each query has its own limit. A request meets the
    result cache once; only the captured pages of requests it does not answer are parsed,
    once, and hits, warnings and new entries all come from that stored parse. Bodies come
    from the page cache where it has a live one, else from the snapshots, and only those
    not cached are given as new entries. ``use_cache`` off neither reads nor fills the
    caches; ``refresh`` skips the reading only.
    """
    own = F.when(F.col("limit") > 0, F.col("limit")).otherwise(DEFAULT_LIMIT)
    limits = queries.select("query_id", (own if "limit" in queries.columns else F.lit(DEFAULT_LIMIT)).alias("limit"))
    limit = limits.agg(F.max("limit")).first()[0] or DEFAULT_LIMIT
    requests = _stored(plan_requests(queries, rules).select(*PAGE, "cache_key", "error"), "requests")
    met = met_requests(requests.where("error is null"), result_cache, now, use_cache, refresh)
    met = _stored(met, "met")
    missed = met.where("entry is null").select(*PAGE, "cache_key")

    asked = result_pages.join(_checked(missed.select(*PAGE)), PAGE, "left_semi")
    parsed = _stored(parsed_pages(asked, rules), "parsed")
    fresh = hits_of(parsed.where("status = 'ok'"), rules, as_of)
    known = met.where("entry is not null").select(*PAGE, "entry.*")
    hits = known.unionByName(fresh.select(*known.columns))
    ranked = search_hits(hits, limit, engine_names(rules), total="salted")
    records = _stored(within_query_limits(ranked, limits, limit), "records")

    live = live_entries(page_cache, now).where(F.lit(use_cache and not refresh))
    fetched = snapshots.join(_checked(_wanted_urls(records)), "url", "left_semi")
    fetched = fetched.join(live.select("url").distinct(), "url", "left_anti")
    refused = requests.where("error is not null").select(*PAGE, F.lit("query").alias("error_kind"), "error")
    return Answer(
        _attach_stored(records, fetched, max_chars, keep_raw, extractor, unit, live),
        result_entries(fresh.join(missed, PAGE), ttl, now, use_cache),
        page_entries(fetched, page_key(F.col("url")), ttl, now, use_cache),
        refused.unionByName(unanswered(missed, parsed)),
    )
