"""Deterministic cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by NUL; a null part counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\0", *texts), 256)


def result_key(engine, query, time_range, safesearch, locale, page) -> Column:
    """Key of one engine's result page for one request."""
    return cache_key(F.lit("result"), engine, query, time_range, safesearch, locale, page)


def page_key(url: Column) -> Column:
    """Key of one page body."""
    return cache_key(F.lit("scrape"), url)
