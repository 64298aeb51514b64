"""Table schemas. Times are TIMESTAMP_NTZ in UTC, so no result depends on the session zone."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
FLAG, DOUBLE, TIME = T.BooleanType(), T.DoubleType(), T.TimestampNTZType()
TEXTS = T.ArrayType(TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


HIT = struct(
    query_id=LONG, engine=TEXT, page=INT, position=INT, url=TEXT, title=TEXT, snippet=TEXT,
    thumbnail=TEXT, published=TIME, cached=FLAG,
)

RECORD = struct(
    url=TEXT, title=TEXT, snippet=TEXT, score=DOUBLE, engines=TEXTS, cached=FLAG,
    published_at=TEXT, raw_html=TEXT, scraped_at=TEXT, content_md=TEXT, error=TEXT,
)

RESULT_PAGE = struct(query_id=LONG, engine=TEXT, page=INT, http_status=INT, html=TEXT)

SNAPSHOT = struct(url=TEXT, title=TEXT, raw_html=TEXT, scraped_at=TEXT, error=TEXT)

# One row per cached hit: an entry is the set of rows that share a cache_key.
RESULT_CACHE = struct(
    cache_key=TEXT, position=INT, url=TEXT, title=TEXT, snippet=TEXT, thumbnail=TEXT,
    published=TIME, expires_at=LONG,
)

# One row per cached page body.
PAGE_CACHE = struct(
    cache_key=TEXT, url=TEXT, title=TEXT, raw_html=TEXT, scraped_at=TEXT, expires_at=LONG
)

EMPTY_RECORD_VALUES = {"url": "", "title": "", "score": 0.0, "cached": False}
