"""Records: the row the stages pass on, and how it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.dates import rfc3339
from hitloom.functions.text import ellipsize, format_cents
from hitloom.schemas import RECORD

RECORD_COLUMNS = RECORD.fieldNames()


def to_records(results: DataFrame, *keep: str) -> DataFrame:
    """Ranked results as records: empty text is null, dates are UTC wire text.

    ``keep`` names columns carried along, such as query_id and rank.
    """
    none = F.lit(None).cast("string")
    return results.select(
        *keep,
        "url",
        "title",
        F.nullif(F.col("snippet"), F.lit("")).alias("snippet"),
        "score",
        F.coalesce(F.col("engines"), F.array().cast("array<string>")).alias("engines"),
        "cached",
        rfc3339(F.col("published")).alias("published_at"),
        none.alias("raw_html"),
        none.alias("scraped_at"),
        none.alias("content_md"),
        none.alias("error"),
    )


def record_json(keep_raw: bool = False) -> Column:
    """One record as a JSON object with explicit nulls; a null raw_html is left out."""
    options = {"ignoreNullFields": "false"}
    without = F.to_json(F.struct(*[c for c in RECORD_COLUMNS if c != "raw_html"]), options)
    if not keep_raw:
        return without
    whole = F.to_json(F.struct(*RECORD_COLUMNS), options)
    return F.when(F.col("raw_html").isNull(), without).otherwise(whole)


def results_json(records: DataFrame, keep_raw: bool = False) -> DataFrame:
    """One JSON array per query in rank order.

    For ranked output only: the per-query limit bounds each array.
    """
    line = F.struct(F.col("rank"), record_json(keep_raw).alias("json"))
    rows = records.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    texts = F.transform("rows", lambda r: r["json"])
    return rows.select(
        "query_id",
        F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("results"),
    )


def _record_day(published_at: Column) -> Column:
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+\-][0-9]{2}:[0-9]{2})$"
    valid = published_at.rlike(shape) & F.try_to_timestamp(published_at).isNotNull()
    return F.when(valid, F.left(published_at, F.lit(10)))


def result_cards(records: DataFrame, width: int = 80) -> DataFrame:
    """Add ``card``: the text lines of one result, numbered by ``rank``, without colour."""
    width = min(max(width, 80), 200)
    title = ellipsize(F.col("title"), min(max(width - 6, 40), 200))
    snippet = ellipsize(F.col("snippet"), width - 4)
    has_snippet = F.coalesce(F.col("snippet"), F.lit("")) != ""
    engines = F.col("engines")
    meta = F.concat_ws(
        " · ",
        F.coalesce(F.get(engines, F.lit(0)), F.lit("-")),
        _record_day(F.col("published_at")),
        F.when(F.col("cached"), F.lit("cached")),
        F.when(F.col("score") > 0, F.concat(F.lit("score: "), format_cents(F.col("score")))),
        F.when(
            F.size(engines) > 1,
            F.concat(F.size(engines).cast("string"), F.lit(" engines")),
        ),
        F.when(
            F.coalesce(F.col("error"), F.lit("")) != "",
            F.concat(F.lit("error: "), F.col("error")),
        ),
    )
    card = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), title,
        F.lit("\n    "), F.col("url"),
        F.when(has_snippet, F.concat(F.lit("\n    "), snippet)).otherwise(""),
        F.lit("\n    ── "), meta, F.lit(" ──\n"),
    )
    return records.withColumn("card", card)
