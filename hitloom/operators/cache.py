"""TTL tables: live entries, lookup, upsert, delete, purge, statistics.

An entry is every row that shares a ``cache_key``: one row in a page cache, one row
per hit in a result cache. Nothing is collected into arrays, so an entry of any size
is spread like other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_TTL = 300


def now_seconds(now: int | Column | None) -> Column:
    if now is None:
        return F.unix_timestamp(F.current_timestamp())
    return F.lit(now) if isinstance(now, int) else now


def expiry(now: int | Column | None, ttl: int) -> Column:
    """``now + ttl``, or 0 (never) when the TTL is not positive."""
    if ttl <= 0:
        return F.lit(0).cast("long")
    return (now_seconds(now) + F.lit(ttl)).cast("long")


def _expires() -> Column:
    return F.coalesce(F.col("expires_at"), F.lit(0))


def live_entries(cache: DataFrame, now: int | Column | None = None) -> DataFrame:
    """Entries that still answer a lookup: no expiry, or an expiry not yet passed."""
    return cache.filter((_expires() <= 0) | (_expires() >= now_seconds(now)))


def purge_expired(cache: DataFrame, now: int | Column | None = None) -> DataFrame:
    """The table without its expired entries."""
    return cache.filter((_expires() <= 0) | (_expires() >= now_seconds(now)))


def purge_all(cache: DataFrame) -> DataFrame:
    """The empty table with the same columns."""
    return cache.filter(F.lit(False))


def delete_entries(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the entries whose key is listed."""
    listed = keys.select("cache_key").distinct()
    return cache.join(listed, "cache_key", "left_anti")


def one_row_entries(new: DataFrame, version: str = "expires_at") -> DataFrame:
    """One row per ``cache_key``, as a page cache has: the highest ``version``, ties by the other columns."""
    rest = [F.desc(c) for c in sorted(new.columns) if c not in ("cache_key", version)]
    newest = Window.partitionBy("cache_key").orderBy(F.desc(version), *rest)
    return new.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def upsert_entries(cache: DataFrame, new: DataFrame, rows_per_entry: str = "many") -> DataFrame:
    """Insert or replace whole entries.

    ``rows_per_entry="one"`` (a page cache) keeps one new row per key, the one that
    expires last.
    """
    if rows_per_entry not in ("one", "many"):
        raise ValueError(f"unknown rows_per_entry {rows_per_entry!r}")
    if rows_per_entry == "one":
        new = one_row_entries(new)
    kept = delete_entries(cache, new)
    return kept.unionByName(new, allowMissingColumns=True)


def latest_entries(rows: DataFrame, version: str) -> DataFrame:
    """Of entries written several times, the rows with the highest ``version``."""
    last = rows.groupBy("cache_key").agg(F.max(version).alias("_last"))
    current = rows.join(last, "cache_key")
    return current.filter(F.col(version) == F.col("_last")).drop("_last")


def storable_pages(pages: DataFrame, use_cache: bool = True) -> DataFrame:
    """Pages worth keeping: no error and a body. None when the cache is off."""
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    return pages.filter(no_error & (F.col("raw_html") != "") & F.lit(use_cache))


def result_entries(
    hits: DataFrame, ttl: int = DEFAULT_TTL, now: int | Column | None = None,
    use_cache: bool = True,
) -> DataFrame:
    """Fresh hits (with their request's ``cache_key``) as result-cache rows.

    A page without hits has no rows here, so an empty answer is never stored.
    """
    fresh = hits.filter(F.lit(use_cache) & ~F.coalesce(F.col("cached"), F.lit(False)))
    return fresh.select(
        "cache_key", "position", "url", "title", "snippet", "thumbnail", "published",
        expiry(now, ttl).alias("expires_at"),
    )


def page_entries(
    pages: DataFrame, key: Column, ttl: int = DEFAULT_TTL, now: int | Column | None = None,
    use_cache: bool = True,
) -> DataFrame:
    """Fetched pages as page-cache rows."""
    return storable_pages(pages, use_cache).select(
        key.alias("cache_key"), "url", "title", "raw_html", "scraped_at",
        expiry(now, ttl).alias("expires_at"),
    )


def lookup_results(
    requests: DataFrame, cache: DataFrame, now: int | Column | None = None,
    use_cache: bool = True, refresh: bool = False,
) -> DataFrame:
    """Hits of the requests the result cache answers, with ``cached`` true."""
    live = live_entries(cache, now).filter(F.lit(use_cache and not refresh))
    return requests.select("query_id", "engine", "page", "cache_key").join(
        live.drop("expires_at"), "cache_key"
    ).select(
        "query_id", "engine", "page", "position", "url", "title", "snippet", "thumbnail",
        "published", F.lit(True).alias("cached"),
    )


def mark_cached(
    requests: DataFrame, cache: DataFrame, now: int | Column | None = None,
    use_cache: bool = True, refresh: bool = False,
) -> DataFrame:
    """The requests with ``answered``: whether the cache has a live entry for them.

    One join with the distinct keys of the live entries; the cache is read once, by key.
    """
    live = live_entries(cache, now).filter(F.lit(use_cache and not refresh))
    live = live.select("cache_key").distinct().withColumn("_live", F.lit(True))
    marked = requests.join(live, "cache_key", "left")
    return marked.select(*requests.columns, F.coalesce("_live", F.lit(False)).alias("answered"))


def split_cached(
    requests: DataFrame, cache: DataFrame, now: int | Column | None = None,
    use_cache: bool = True, refresh: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Requests the cache answers, and requests left to fetch.

    Each of the two reads the cache; a plan that needs both filters ``mark_cached``.
    """
    marked = mark_cached(requests, cache, now, use_cache, refresh)
    return marked.filter("answered").drop("answered"), marked.filter(~F.col("answered")).drop("answered")


_HIT_FIELDS = "struct<position:int,url:string,title:string,snippet:string,thumbnail:string,published:timestamp_ntz,cached:boolean>"


def met_requests(
    requests: DataFrame, cache: DataFrame, now: int | Column | None = None,
    use_cache: bool = True, refresh: bool = False,
) -> DataFrame:
    """(query_id, engine, page, cache_key, entry): each request once per hit of its live entry.

    A request the cache does not answer has one row, with a null ``entry``.
    """
    asked = requests.select("query_id", "engine", "page", "cache_key").distinct()
    live = live_entries(cache, now).filter(F.lit(use_cache and not refresh))
    hit = F.struct(*_hit_columns(), F.lit(True).alias("cached")).cast(_HIT_FIELDS).alias("entry")
    return asked.join(live.select("cache_key", hit), "cache_key", "left")


def _hit_columns() -> list[Column]:
    return [F.col(name) for name in ("position", "url", "title", "snippet", "thumbnail", "published")]


def cached_and_fresh(
    requests: DataFrame, cache: DataFrame, fetched: DataFrame,
    now: int | Column | None = None, use_cache: bool = True, refresh: bool = False,
) -> DataFrame:
    """Cached hits of the answered requests and fetched hits of the others.

    Each request meets its live entries in one join, which also tells a hit from a miss;
    only a miss then finds the fetched hits of its page.  The cache and the fetched hits are
    read once each, and a request that is listed twice counts once.
    """
    keys = ["query_id", "engine", "page"]
    fresh = fetched.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.struct(*_hit_columns(), F.col("cached")).cast(_HIT_FIELDS).alias("_hit")
    )
    missed = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("entry").isNull()]
    met = met_requests(requests, cache, now, use_cache, refresh).join(fresh, missed, "left")
    hit = F.coalesce("entry", "_hit")
    return met.select(*keys, hit.alias("_found")).filter("_found is not null").select(*keys, "_found.*")


def cache_stats(
    cache: DataFrame, now: int | Column | None = None, rows_per_entry: str = "one"
) -> DataFrame:
    """One row: number of entries and of expired entries.

    Counting rows combines on the map side; ``rows_per_entry="many"`` (a result
    cache) counts distinct keys instead.
    """
    if rows_per_entry not in ("one", "many"):
        raise ValueError(f"unknown rows_per_entry {rows_per_entry!r}")
    entries = cache.select("cache_key", _expires().alias("expires_at"))
    if rows_per_entry == "many":
        entries = entries.groupBy("cache_key").agg(F.max("expires_at").alias("expires_at"))
    at = F.col("expires_at")
    return entries.agg(
        F.count("*").alias("entries"),
        F.count_if((at > 0) & (at < now_seconds(now))).alias("expired"),
    )
