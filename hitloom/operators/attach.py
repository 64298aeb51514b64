"""Attach page bodies to records; choose among captures of one URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitloom.operators.cache import live_entries

NO_SNAPSHOT = "navigate: no snapshot"
MIN_CHARS = 500
POLL_SECONDS = 5
BROADCAST_URLS = 200_000


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def url_join_key(columns: list[str]) -> Column:
    """The URL; rows without one get keys no page has, so they spread over the tasks."""
    spread = F.pmod(F.xxhash64(*columns), F.lit(1024)).cast("string")
    has_url = F.coalesce(F.col("url"), F.lit("")) != ""
    return F.when(has_url, F.col("url")).otherwise(F.concat(F.lit("\0"), spread))


def attach_pages(
    records: DataFrame,
    snapshots: DataFrame,
    cache: DataFrame | None = None,
    now: int | Column | None = None,
    reset_error: bool = False,
) -> DataFrame:
    """Records with the body of their exact URL.

    Of several snapshots or live entries of a URL the one scraped last counts (to choose
    by readiness see ``pick_snapshot``). With a page ``cache``
    a live entry wins over the snapshot: its title overwrites even when empty, and
    ``reset_error`` clears error and content too. A fetched title overwrites only
    when it is not empty. A record without a URL passes unchanged; a URL with no
    page gets an error. Bodies are the wide side: call this after the top-k cut.
    """
    joined = records.withColumn("_key", url_join_key(records.columns))
    found = []
    if cache is not None:
        live = live_entries(cache, now).withColumn("error", F.lit(None).cast("string"))
        joined = joined.join(_keyed_pages(live, "_live", from_cache=True), "_key", "left")
        found.append(F.col("_live"))
    joined = joined.join(_keyed_pages(snapshots, "_fetched", from_cache=False), "_key", "left")
    found.append(F.col("_fetched"))
    return apply_page(
        joined.withColumn("_page", F.coalesce(*found)), records.columns, reset_error
    )


def _keyed_pages(pages: DataFrame, name: str, from_cache: bool) -> DataFrame:
    fields = ["title", "raw_html", "scraped_at", "error"]
    keyed = pages.select(
        F.col("url").alias("_key"),
        F.struct(*fields, F.lit(from_cache).alias("from_cache")).alias(name),
    )
    return latest_page(keyed, F.col(name))


def latest_page(pages: DataFrame, page: Column, *rest: Column, prefer: Column | None = None) -> DataFrame:
    """One row per ``_key``: a preferred one first, then the page scraped last, ties by the other fields.

    The rows are dealt by the key, as the join with them asks, and a map task passes on
    one row per key, so a URL captured very often stays cheap.
    """
    first = [] if prefer is None else [F.desc(prefer)]
    newest = Window.partitionBy("_key").orderBy(*first, F.desc(page["scraped_at"]), page, *rest)
    return pages.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def apply_page(joined: DataFrame, columns: list[str], reset_error: bool) -> DataFrame:
    """Row rules of a scrape, given the page struct ``_page`` (null: none found)."""
    page = F.col("_page")
    has_url = F.coalesce(F.col("url"), F.lit("")) != ""
    cached = F.coalesce(page["from_cache"], F.lit(False))
    missing = F.when(page.isNull(), F.lit(NO_SNAPSHOT)).otherwise(page["error"])
    new = {
        "raw_html": _none_if_empty(page["raw_html"]),
        "scraped_at": _none_if_empty(page["scraped_at"]),
        "title": F.when(cached, F.coalesce(page["title"], F.lit(""))).otherwise(
            F.coalesce(_none_if_empty(page["title"]), F.col("title"))
        ),
        "error": F.when(cached, F.lit(None) if reset_error else F.col("error")).otherwise(
            F.coalesce(_none_if_empty(missing), F.col("error"))
        ),
    }
    if reset_error:
        new["content_md"] = F.when(~cached, F.col("content_md"))
    return joined.select(
        *[
            (F.when(has_url, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c)
            for c in columns
        ]
    )


def _rank_number(tier: Column, waited: Column, length: Column) -> Column:
    """The order of a capture as one LONG: tier, then time, then length, nulls before all.

    Times beyond twelve days and texts beyond half a billion characters share the ends of
    their ranges, so equal numbers need an exact comparison and unequal ones do not.
    """

    def within(value: Column, bits: int) -> Column:
        top = 1 << (bits - 1)
        held = F.least(F.greatest(value.cast("double"), F.lit(1.0 - top)), F.lit(top - 1.0))
        return F.coalesce(held.cast("long"), F.lit(-top).cast("long")) + F.lit(top)

    return F.shiftleft(tier.cast("long"), 61) + F.shiftleft(within(waited, 31), 30) + within(length, 30)


def pick_snapshot(
    captures: DataFrame, min_chars: int = MIN_CHARS, poll_seconds: int = POLL_SECONDS,
    broadcast_urls: int = BROADCAST_URLS,
) -> DataFrame:
    """One capture per URL, as a poll for enough text would have taken it.

    ``captures`` has url, waited_ms (time since navigation), text_length and any other
    columns, bodies among them. The earliest capture in the poll window with enough text
    wins, else the latest in the window, else the earliest of all; ties go by the other columns.

    The winners are found first, from the narrow columns, by an aggregate of fixed width. Up to
    ``broadcast_urls`` of them are counted and broadcast, so that bodies are read and moved
    for the winners only. Where there are more, bucketed captures (``save_snapshots``) stay in
    their task, and of others a map task passes on one body per URL.
    """
    waited, length = F.col("waited_ms"), F.col("text_length")
    in_window = waited <= poll_seconds * 1000
    tier = F.when(in_window & (length >= min_chars), 1).when(in_window, 2).otherwise(3)
    sign = F.when(tier == 2, -1).otherwise(1)
    number = _rank_number(tier, waited * sign, length * sign)

    best = captures.groupBy("url").agg(F.min(number).alias("_best")).withColumnRenamed("url", "_url")
    if best.limit(broadcast_urls + 1).count() <= broadcast_urls:
        won = F.col("url").eqNullSafe(F.col("_url")) & (number == F.col("_best"))
        captures = captures.join(F.broadcast(best), won, "left_semi")
    rest = [c for c in captures.columns if c != "url"]
    first = Window.partitionBy("url").orderBy(tier, waited * sign, length * sign, *rest)
    return captures.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
