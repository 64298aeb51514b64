"""The registered queries: one or more per operator, over the whole given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.functions.dates import parse_result_date, rfc3339, strip_date_prefix
from hitloom.functions.html import body_text_length, main_text, page_metadata, page_title, text_blocks
from hitloom.functions.keys import page_key, result_key
from hitloom.functions.text import (
    longest_of,
    merge_shadow_text,
    quote_bangs,
    truncate_text,
)
from hitloom.functions.urls import normalize_url, url_host
from hitloom.operators.attach import attach_pages, pick_snapshot
from hitloom.operators.cache import (
    cache_stats,
    cached_and_fresh,
    delete_entries,
    live_entries,
    lookup_results,
    mark_cached,
    page_entries,
    purge_expired,
    result_entries,
    upsert_entries,
)
from hitloom.operators.extract import (
    extract_hits,
    page_status,
    raw_hits,
    search_warnings,
    warnings,
)
from hitloom.operators.merge import (
    merge_hits,
    position_lists,
    rank_results,
    seen_order,
    union_hits,
    within_page_limit,
    within_query_limits,
)
from hitloom.operators.records import result_cards, results_json, to_records
from hitloom.operators.requests import engine_ranks, plan_requests, select_engines
from hitloom.operators.rules import Rule
from hitloom.operators.sanitize import sanitize
from hitloom.operators.status import classify_status, health_summary
from hitloom.plans import inputs
from hitloom.plans.inputs import NOW, as_of, table
from hitloom.plans.run import (
    Answer,
    answer_queries,
    attach_text,
    run_search,
    search_cached,
    search_hits,
    search_pages,
)
from hitloom.schemas import PAGE_CACHE
from hitloom.session import scratch_dir
from hitloom.sources.cache_log import read_log
from hitloom.sources.ndjson import read_records, write_records
from hitloom.sources.tables import (
    clear_cache,
    commit_version,
    read_cache,
    read_result_pages,
    save_result_pages,
    save_snapshots,
)
from hitloom.streaming.late import finished, stream_late_pages, write_heartbeats
from hitloom.streaming.stages import (
    stream_attach_pages,
    stream_cache_upkeep,
    stream_sanitize,
)

Query = Callable[[SparkSession, str], DataFrame]


def joined(engines: Column) -> Column:
    return F.array_join(engines, ",")


def normalize_urls(spark, d):
    url = F.col("url")
    return inputs.hits(spark, d).select(
        "query_id", "engine", "page", "position",
        normalize_url(url).alias("url_key"), url_host(url).alias("host"),
    )


def merged_rows(spark, d):
    merged = merge_hits(inputs.hits(spark, d))
    return merged.select(
        "query_id", "url_key", "url", "title", "snippet", "thumbnail",
        rfc3339(F.col("published")).alias("published"), "cached",
        joined(F.col("engines")).alias("engines"), "n_hits", F.round("score", 6).alias("score"),
    )


def positions(spark, d):
    """Positions in first-seen order; ``5x2`` is position 5 twice in one slot."""
    lists = position_lists(inputs.hits(spark, d))
    run = lambda r: F.concat_ws("x", r["position"].cast("string"), r["n"].cast("string"))
    runs = F.array_join(F.transform("positions", run), ",")
    return lists.select("query_id", "url_key", runs.alias("positions"))


def ranked(spark, d):
    rows = rank_results(merge_hits(inputs.hits(spark, d)))
    return rows.select(
        "query_id", "rank", "total", "url", joined(F.col("engines")).alias("engines"),
        F.round("score", 6).alias("score"),
    )


def query_limits(spark, d):
    """Each query keeps as many results as it asks for, between 1 and 50."""
    hits = inputs.hits(spark, d)
    asked = inputs.hits(spark, d).select("query_id").distinct().withColumn(
        "limit", (F.col("query_id") * 7 % 51).cast("int")
    )
    rows = within_query_limits(rank_results(merge_hits(hits), 50, "none"), asked, 50)
    return rows.select("query_id", "rank", "url")


def longest_title(spark, d):
    keyed = inputs.hits(spark, d).withColumn("url_key", normalize_url(F.col("url")))
    return keyed.groupBy("query_id", "url_key").agg(
        longest_of(F.col("title"), seen_order()).alias("title")
    )


def engine_selection(spark, d):
    rows = select_engines(inputs.queries_table(spark, d).select("query_id", "engines"))
    return rows.withColumn("rank", engine_ranks())


def page_limit(spark, d):
    limit = (F.col("query_id") % 70).cast("int")
    rows = within_page_limit(inputs.hits(spark, d), limit)
    return rows.select("query_id", "engine", "page", "position")


def request_plan(spark, d):
    rows = plan_requests(inputs.queries_table(spark, d))
    return rows.select(
        "query_id", "engine", "page", F.col("seq.engine_at").alias("engine_at"), "url", "form",
        "country", "ui_lang", "kl", "safesearch", "cache_key", "error",
    )


def bangs(spark, d):
    marked = F.regexp_replace("text", "(^| )([a-z])", "$1!$2")
    return table(spark, d, "documents").select("doc_id", quote_bangs(marked).alias("query"))


def date_texts(spark, d):
    """Dates as a result page prints them, and a snippet that may start with one."""
    e = F.col("event_id")
    units = ["minute", "hour", "day", "week", "month", "year"]
    n = (e % 60).cast("string")
    text = (
        F.when(e % 8 == 6, F.date_format("ts", "MMM d, yyyy"))
        .when(e % 8 == 7, F.concat(n, F.lit(" decades ago")))
        .otherwise(
            F.concat(n, F.lit(" "), inputs.choose(e, units + units[:2]),
                     F.when(e % 60 == 1, " ago").otherwise("s ago"))
        )
    )
    rows = table(spark, d, "events").select("event_id", "event_type", text.alias("date_text"))
    dash = F.when(F.col("event_id") % 4 == 3, " ").otherwise(" - ")
    return rows.withColumn("snippet", F.concat("date_text", dash, "event_type", F.lit(" seen.")))


def result_dates(spark, d):
    parsed = parse_result_date(F.col("date_text"), as_of())
    rows = date_texts(spark, d).withColumn("published", parsed)
    cut = strip_date_prefix(F.col("snippet"), F.col("date_text"), F.col("published"))
    return rows.select(
        "event_id", "date_text", rfc3339(F.col("published")).alias("published"),
        cut.alias("snippet"),
    )


def sanitize_pages(spark, d):
    rows = sanitize(inputs.page_records(spark, d), strip="sanitized")
    return rows.select(
        "page_id", "content_md", "extracted_title", "published_at",
        F.md5("raw_html").alias("raw_md5"), "error",
    )


def truncate_content(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        F.length(truncate_text(F.col("text"), 1000, "chars")).alias("n_chars"),
        F.md5(truncate_text(F.col("text"), 1000, "chars")).alias("text_md5"),
        F.octet_length(truncate_text(F.col("text"), 1000)).alias("n_bytes"),
        F.md5(truncate_text(F.col("text"), 1000)).alias("cut_md5"),
    )


def page_titles(spark, d):
    return table(spark, d, "pages").select(
        "page_id", page_title(F.col("html")).alias("title"),
        body_text_length(F.col("html")).cast("bigint").alias("text_length"),
    )


def main_text_blocks(spark, d):
    """Each block of the main text, with the cells of table rows and the links."""
    rows = inputs.structured_pages(spark, d).select("page_id", F.posexplode(text_blocks(F.col("html"))).alias("at", "b"))
    link = lambda x: F.concat_ws("=", x["text"], x["url"])
    return rows.select(
        "page_id", (F.col("at") + 1).cast("bigint").alias("block_no"), "b.kind", "b.text",
        F.array_join("b.cells", "|").alias("cells"), F.array_join(F.transform("b.links", link), " ").alias("links"),
    )


def main_text_markdown(spark, d):
    """The same text as Markdown lines, and as plain ones."""
    html = F.col("html")
    return inputs.structured_pages(spark, d).select(
        "page_id", main_text(html, links=True).alias("markdown"), main_text(html).alias("plain")
    )


def page_dates(spark, d):
    """Dates put into the heads of the pages, then read back."""
    p = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 500).cast("int")), "yyyy-MM-dd")
    # Around the day; the last two hold no date of publication.
    forms = [
        ('<meta property="article:published_time" content="', 'T10:00:00Z">'),
        ('<meta content="', '" name="date">'),
        ('<time datetime="', '">'),
        ("<meta name='DatePublished' content='", "'>"),
        ("<meta itemprop=pubdate content=", ">"),
        ('<script type="application/ld+json">{"@type": "Article", "datePublished" : "', 'T08:00:00+02:00"}</script>'),
        ('<meta data-name="date" content="', '">'),
        ('<meta name="date" content="2024-02-30"><meta name="author" content="', '">'),
    ]
    tag = F.concat(
        choose_text(p, [before for before, _ in forms]), day, choose_text(p, [after for _, after in forms]),
        F.when(p % 3 == 0, F.concat(F.lit("<meta content='Shared &amp; told ' property='og:title'>"))).otherwise(""),
    )
    html = F.replace("html", F.lit("</head>"), F.concat(tag, F.lit("</head>")))
    rows = table(spark, d, "pages").select("page_id", page_metadata(html).alias("m"))
    return rows.select("page_id", "m.title", "m.published_at")


def choose_text(index, values):
    return F.get(F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


NAV_LINKS = Rule(name="nav", rank=1, container="nav li", url="a[href]", title="a")


def extract_links(spark, d):
    found = raw_hits(F.col("html"), F.lit("nav"), (NAV_LINKS,))
    rows = table(spark, d, "pages").select("page_id", found.alias("links"))
    return rows.select("page_id", F.posexplode("links").alias("at", "link")).select(
        "page_id", (F.col("at") + 1).cast("bigint").alias("link_no"),
        F.col("link.url").alias("url"), F.col("link.title").alias("text"),
    )


def extracted_hits(spark, d):
    rows = extract_hits(inputs.result_pages(spark, d), as_of=as_of())
    return rows.withColumn("published", rfc3339(F.col("published")))


def statuses(spark, d):
    rows = page_status(inputs.result_pages(spark, d))
    return rows.select("query_id", "engine", "page", "status", "error_kind", "error")


def page_warnings(spark, d):
    return warnings(inputs.result_pages(spark, d))


def all_warnings(spark, d):
    """The plan of all queries against the captured pages: most requests have none."""
    return search_warnings(plan_requests(inputs.queries_table(spark, d)), inputs.result_pages(spark, d))


def ranked_records(spark, d) -> DataFrame:
    return search_hits(inputs.hits(spark, d), 50)


def body_digest(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(
        *columns, "url", "title", F.md5("raw_html").alias("raw_md5"), "scraped_at", "error"
    )


def attached(spark, d):
    rows = attach_pages(ranked_records(spark, d), inputs.snapshots(spark, d))
    return body_digest(rows, "query_id", "rank")


def attached_cached(spark, d):
    records = ranked_records(spark, d).withColumn("error", F.lit("earlier"))
    rows = attach_pages(
        records, inputs.snapshots(spark, d), inputs.page_cache(spark, d), NOW, reset_error=True
    )
    return body_digest(rows, "query_id", "rank")


def cache_keys(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        result_key(
            F.col("event_type"), F.col("props"), F.lit(""), F.lit(0), F.lit("en-US"),
            F.col("user_id"),
        ).alias("result_key"),
        page_key(F.col("props")).alias("page_key"),
    )


def request_table(spark, d) -> DataFrame:
    return (
        inputs.hits(spark, d)
        .select("query_id", "engine", "page").distinct()
        .withColumn("cache_key", inputs.request_key())
    )


def cache_lookup(spark, d):
    rows = cached_and_fresh(
        request_table(spark, d), inputs.result_cache(spark, d), inputs.hits(spark, d), NOW
    )
    return rows.select("query_id", "engine", "page", "position", "url", "cached")


def cache_split(spark, d):
    rows = mark_cached(request_table(spark, d), inputs.result_cache(spark, d), NOW)
    answer = F.when(F.col("answered"), "hit").otherwise("miss")
    return rows.select("query_id", "engine", "page", answer.alias("answer"))


def fresh_page_entries(spark, d) -> DataFrame:
    pages = inputs.snapshots(spark, d)
    return page_entries(pages, page_key(F.col("url")), 300, NOW)


def cache_upsert(spark, d):
    fresh = fresh_page_entries(spark, d)
    older = fresh.withColumn("expires_at", F.col("expires_at") - 10).withColumn("title", F.lit("older"))
    rows = upsert_entries(inputs.page_cache(spark, d), fresh.unionByName(older), rows_per_entry="one")
    return rows.select("cache_key", "url", "title", "scraped_at", "expires_at")


def cache_store(spark, d):
    """Fresh hits are stored and answer the same requests until they expire.

    Pages without hits and hits of a run without cache are not stored.
    """
    keys = ["query_id", "engine", "page"]
    asked = request_table(spark, d)
    found = inputs.hits(spark, d).filter(F.col("page") < 5).join(asked, keys)
    unused = result_entries(inputs.hits(spark, d).join(asked, keys), 300, NOW, use_cache=False)
    entries = union_hits(result_entries(found, 300, NOW), unused)
    at_last, later = (lookup_results(asked, entries, NOW + t) for t in (300, 301))
    rows = union_hits(at_last, later)
    return rows.select(*keys, "position", "url", "cached")


def cache_purge_all(spark, d):
    """Entries before and after the cache is emptied; emptying an absent cache is no error."""
    root = scratch_dir(spark, "purge")
    clear_cache(spark, root)
    commit_version(inputs.result_cache(spark, d), root)
    before = read_cache(spark, root).select(F.count("*").alias("before"))
    stored = before.first()[0]
    clear_cache(spark, root)
    return read_cache(spark, root).select(F.lit(stored).cast("bigint").alias("before"), F.count("*").alias("after"))


def cache_purge(spark, d):
    """Drop the entries of pages whose capture failed, then what expired."""
    failed = inputs.snapshots(spark, d).filter(F.col("error") != "")
    keys = failed.select(page_key(F.col("url")).alias("cache_key"))
    rows = purge_expired(delete_entries(inputs.page_cache(spark, d), keys), NOW)
    return rows.select("cache_key", "url", "expires_at")


def cache_statistics(spark, d):
    pages = cache_stats(inputs.page_cache(spark, d), NOW)
    results = cache_stats(inputs.result_cache(spark, d), NOW, "many")
    return union_hits(
        pages.withColumn("cache", F.lit("pages")), results.withColumn("cache", F.lit("results"))
    )


def status_classes(spark, d):
    return classify_status(inputs.probes(spark, d)).select("event_id", "severity", "tip")


def status_summary(spark, d):
    return health_summary(classify_status(inputs.probes(spark, d)))


def cards(spark, d):
    records = ranked_records(spark, d).withColumn("score", F.round("score", 6))
    rows = result_cards(records, 100)
    return rows.select("query_id", "rank", "card")


def json_results(spark, d):
    rows = results_json(ranked_records(spark, d))
    shape = "array<struct<url:string,snippet:string,engines:array<string>,error:string>>"
    parsed = rows.select("query_id", F.from_json("results", shape).alias("r"))
    return parsed.select(
        "query_id",
        F.size("r").cast("bigint").alias("n_results"),
        F.array_join(F.col("r.url"), " ").alias("urls"),
        F.array_join(F.transform("r", lambda x: joined(x["engines"])), ";").alias("engines"),
        F.array_join(F.transform("r", lambda x: F.coalesce(x["snippet"], F.lit("null"))), "|")
        .alias("snippets"),
    )


def picked_snapshot(spark, d):
    rows = pick_snapshot(inputs.captures(spark, d))
    return rows.select("url", "waited_ms", "text_length", "event_id", F.md5("raw_html").alias("raw_md5"))


def shadow_merge(spark, d):
    shadow = F.when(
        F.col("page_id") % 2 == 0, F.array_join(inputs.paragraphs(F.col("html")), " ")
    ).otherwise("")
    rows = table(spark, d, "pages").select("page_id", merge_shadow_text(F.col("html"), shadow).alias("h"))
    return rows.select("page_id", F.md5("h").alias("html_md5"), F.length("h").cast("bigint").alias("n_chars"))


def record_rows(records: DataFrame) -> DataFrame:
    return records.select(
        "url", "title", "snippet", "score", joined(F.col("engines")).alias("engines"), "cached",
        "published_at", F.md5("raw_html").alias("raw_md5"), "scraped_at", "content_md", "error",
    )


def record_roundtrip(spark, d):
    path = scratch_dir(spark, "records")
    write_records(inputs.page_records(spark, d), path, keep_raw=True)
    return record_rows(read_records(spark, path))


def projected_records(spark, d):
    ranked_rows = rank_results(merge_hits(inputs.hits(spark, d)), 50)
    rows = to_records(ranked_rows, "query_id", "rank")
    return rows.select(
        "query_id", "rank", "url", "title", "snippet", F.round("score", 6).alias("score"),
        joined(F.col("engines")).alias("engines"), "cached", "published_at",
    )


def streamed_sanitize(spark, d):
    base = scratch_dir(spark, "sanitize")
    write_records(inputs.page_records(spark, d), f"{base}/in", keep_raw=True)
    stream_sanitize(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return record_rows(read_records(spark, f"{base}/out"))


def streamed_attach(spark, d):
    base = scratch_dir(spark, "attach")
    write_records(ranked_records(spark, d), f"{base}/in")
    stream_attach_pages(
        spark, f"{base}/in", inputs.snapshots(spark, d), f"{base}/out", f"{base}/checkpoint"
    ).awaitTermination()
    return body_digest(read_records(spark, f"{base}/out"), "snippet")


def streamed_late(spark, d):
    """Two runs of one checkpoint: the records with the first captures, then the late captures."""
    base = scratch_dir(spark, "late")
    records, captures, sink, checkpoint = (f"{base}/{name}" for name in ("records", "captures", "out", "checkpoint"))
    inputs.waiting_records(spark, d, ranked_records(spark, d)).write.parquet(records)
    found = inputs.late_captures(spark, d)
    for late in (False, True):
        found.where(F.col("late") == late).drop("late").write.mode("append").parquet(captures)
        if late:
            over = dt.datetime.fromtimestamp(inputs.QUEUED + 1000, dt.timezone.utc)
            write_heartbeats(spark, over, records, captures)
        finished(stream_late_pages(spark, records, captures, sink, checkpoint, wait=30, disorder=300))
    return body_digest(read_records(spark, sink), "snippet")


def streamed_upkeep(spark, d):
    base = scratch_dir(spark, "upkeep")
    columns = PAGE_CACHE.fieldNames()
    old, new = inputs.page_cache(spark, d), fresh_page_entries(spark, d)
    for name, entries in (("1", old), ("2", new)):
        entries.select(*columns).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(PAGE_CACHE).parquet(f"{base}/in")
        stream_cache_upkeep(
            stream, f"{base}/cache", f"{base}/checkpoint", PAGE_CACHE, now=NOW
        ).awaitTermination()
    rows = live_entries(read_log(spark, f"{base}/cache", PAGE_CACHE), NOW)
    return rows.select("cache_key", "url", "title", "scraped_at", "expires_at")


def text_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "query_id", "rank", "total", "url", "title", "snippet", F.round("score", 6).alias("score"),
        joined(F.col("engines")).alias("engines"), "cached", "published_at", "scraped_at",
        F.md5("content_md").alias("content_md5"), "extracted_title", "error",
    )


def search_with_text(spark, d):
    return text_rows(attach_text(ranked_records(spark, d), inputs.snapshots(spark, d)))


def cached_search(spark, d):
    rows = search_cached(
        request_table(spark, d), inputs.result_cache(spark, d), inputs.hits(spark, d), 50, now=NOW
    )
    return rows.select(
        "query_id", "rank", "total", "url", "title", F.round("score", 6).alias("score"),
        joined(F.col("engines")).alias("engines"), "cached", "published_at",
    )


def search_result_pages(spark, d):
    rows = search_pages(inputs.result_pages(spark, d), 50, as_of=as_of())
    return rows.select(
        "query_id", "rank", "total", "url", "title", "snippet", F.round("score", 6).alias("score"),
        joined(F.col("engines")).alias("engines"), "published_at",
    )


def search_run(spark, d):
    rows = run_search(
        inputs.result_pages(spark, d), inputs.snapshots(spark, d), 50, as_of=as_of()
    )
    return text_rows(rows)


def search_stored(spark, d):
    """The search over stored tables: pages in folders by number, of which two are read, bodies in buckets by URL."""
    base = scratch_dir(spark, "stored")
    save_result_pages(inputs.result_pages(spark, d), f"{base}/pages")
    bodies = f"bodies_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    save_snapshots(inputs.snapshots(spark, d), bodies, buckets, path=f"{base}/bodies")
    return text_rows(run_search(read_result_pages(spark, f"{base}/pages"), spark.table(bodies), 20, as_of=as_of()))


def answer(spark, d) -> Answer:
    return answer_queries(
        inputs.page_queries(spark, d), inputs.result_pages(spark, d), inputs.snapshots(spark, d),
        inputs.answered_before(spark, d), inputs.page_cache(spark, d), NOW, as_of=as_of(),
    )


def answer_records(spark, d):
    return text_rows(answer(spark, d).records)


def answer_entries(spark, d):
    """What the plan gives the two caches to keep."""
    found = answer(spark, d)
    hits = found.result_entries.select(F.lit("results").alias("cache"), "cache_key", "position", "url", "title", "expires_at")
    pages = found.page_entries.select(
        F.lit("pages").alias("cache"), "cache_key", F.lit(None).cast("int").alias("position"), "url", "title", "expires_at"
    )
    return hits.unionByName(pages)


def answer_warnings(spark, d):
    return answer(spark, d).warnings


QUERIES: dict[str, Query] = {
    "normalize_urls": normalize_urls,
    "merge_hits": merged_rows,
    "hit_positions": positions,
    "rank_results": ranked,
    "query_limits": query_limits,
    "longest_title": longest_title,
    "engine_selection": engine_selection,
    "page_limit": page_limit,
    "plan_requests": request_plan,
    "quote_bangs": bangs,
    "result_dates": result_dates,
    "sanitize_pages": sanitize_pages,
    "truncate_content": truncate_content,
    "page_titles": page_titles,
    "page_dates": page_dates,
    "main_text_blocks": main_text_blocks,
    "main_text_markdown": main_text_markdown,
    "extract_links": extract_links,
    "extract_hits": extracted_hits,
    "page_status": statuses,
    "page_warnings": page_warnings,
    "search_warnings": all_warnings,
    "attach_pages": attached,
    "attach_cached_pages": attached_cached,
    "cache_keys": cache_keys,
    "cache_lookup": cache_lookup,
    "cache_split": cache_split,
    "cache_upsert": cache_upsert,
    "cache_store": cache_store,
    "cache_purge": cache_purge,
    "cache_purge_all": cache_purge_all,
    "cache_stats": cache_statistics,
    "status_classes": status_classes,
    "status_summary": status_summary,
    "result_cards": cards,
    "results_json": json_results,
    "pick_snapshot": picked_snapshot,
    "shadow_merge": shadow_merge,
    "record_roundtrip": record_roundtrip,
    "to_records": projected_records,
    "stream_sanitize": streamed_sanitize,
    "stream_attach": streamed_attach,
    "stream_late_pages": streamed_late,
    "stream_cache_upkeep": streamed_upkeep,
    "search_with_text": search_with_text,
    "search_cached": cached_search,
    "search_result_pages": search_result_pages,
    "search_run": search_run,
    "search_stored": search_stored,
    "answer_records": answer_records,
    "answer_entries": answer_entries,
    "answer_warnings": answer_warnings,
}
