"""Records with HTML to records with text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.html import sanitize_html

MAX_CHARS = 25_000


def _sanitizable() -> Column:
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    return no_error & (F.coalesce(F.col("raw_html"), F.lit("")) != "")


def strip_html(records: DataFrame, strip: str = "all") -> DataFrame:
    """Empty ``raw_html`` on all rows, or on none."""
    if strip not in ("all", "none"):
        raise ValueError(f"unknown strip {strip!r}")
    if strip == "none":
        return records
    return records.withColumn("raw_html", F.lit(None).cast("string"))


def apply_sanitized(
    records: DataFrame, result: Column, strip: str = "all", applies: Column | None = None
) -> DataFrame:
    """Row rules of a sanitize, given the struct ``result`` of ``sanitize_html``.

    A row in error or without HTML passes unchanged. A date found in the page only
    fills a missing one; the title found there is returned as ``extracted_title``.
    ``strip`` empties raw_html on all rows, on the sanitized ones, or on none.
    """
    if strip not in ("all", "sanitized", "none"):
        raise ValueError(f"unknown strip {strip!r}")
    rows = records.withColumn("_does", _sanitizable() if applies is None else applies)
    rows = rows.withColumn("_r", F.when(F.col("_does"), result))
    does, r = F.col("_does"), F.col("_r")
    kept_html = {
        "all": F.lit(None).cast("string"),
        "sanitized": F.when(~does, F.col("raw_html")),
        "none": F.col("raw_html"),
    }[strip]
    new = {
        "content_md": F.when(does, r["content_md"]).otherwise(F.col("content_md")),
        "error": F.coalesce(r["error"], F.col("error")),
        "published_at": F.coalesce(F.col("published_at"), r["published_at"]),
        "raw_html": kept_html,
    }
    return rows.select(
        *[new.get(c, F.col(c)).alias(c) for c in records.columns],
        r["title"].alias("extracted_title"),
    )


def sanitize(
    records: DataFrame,
    max_chars: int = MAX_CHARS,
    extractor=None,
    strip: str = "all",
    unit: str = "bytes",
) -> DataFrame:
    """Text of every record that has HTML and no error. A projection: no shuffle."""
    result = sanitize_html(F.col("raw_html"), max_chars, extractor, unit)
    return apply_sanitized(records, result, strip)
