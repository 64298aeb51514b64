"""Dates as search pages print them: absolute or relative to the time of capture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitloom.functions.text import let, trim_space

# A count, a unit, then anything.
RELATIVE = r"^([+\-]?[0-9]+)\s+(\S+)"
# Ten thousand years: a larger shift leaves the range of timestamps from any date.
MAX_SECONDS, MAX_MONTHS = 315_576_000_000, 120_000


def utc_now() -> Column:
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def rfc3339(ts: Column) -> Column:
    """UTC wire text of a TIMESTAMP_NTZ, to the second. The session zone plays no part."""
    text = F.left(ts.cast("string"), F.lit(19))
    return F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))


def _months_before(as_of: Column, months: Column) -> Column:
    """Calendar shift in which a missing day runs over: 31 March minus a month is 3 March."""
    first = F.add_months(F.trunc(F.to_date(as_of), "MM"), -months)
    day = F.date_add(first, F.dayofmonth(as_of) - F.lit(1))
    midnight = F.to_date(as_of).cast("timestamp_ntz")
    return day.cast("timestamp_ntz") + (as_of - midnight)


def parse_result_date(text: Column, as_of: Column | None = None) -> Column:
    """``Mar 15, 2026`` or ``<n> minute(s)|hour|day|week|month|year ...`` before ``as_of``.

    Anything else is null. A count may have any number of digits; a result outside
    the years 1 to 9999 is null.
    """
    now = (utc_now() if as_of is None else as_of).cast("timestamp_ntz")

    def relative(parts: Column) -> Column:
        n, unit = parts["n"], parts["unit"]
        seconds = (
            F.when(unit == "minute", F.lit(60))
            .when(unit == "hour", F.lit(3600))
            .when(unit == "day", F.lit(86400))
            .when(unit == "week", F.lit(604800))
        )
        total = F.try_multiply(n, seconds.cast("long"))
        near = F.when(total.between(-MAX_SECONDS, MAX_SECONDS), total)
        elapsed = F.make_dt_interval(secs=near.cast("decimal(18,0)"))
        months = F.when(unit == "month", n).when(unit == "year", F.try_multiply(n, F.lit(12).cast("long")))
        shift = F.when(months.between(-MAX_MONTHS, MAX_MONTHS), months).cast("int")
        shifted = F.when(near.isNotNull(), now - elapsed).when(shift.isNotNull(), _months_before(now, shift))
        return let(shifted, lambda at: F.when(F.year(at).between(1, 9999), at))

    def parse(s: Column) -> Column:
        spaced = F.regexp_replace(s, " +", " ")
        is_day = spaced.rlike(r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$")
        day = F.try_to_date(F.when(is_day, spaced), "MMM d, yyyy").cast("timestamp_ntz")
        number = F.nullif(F.regexp_extract(s, RELATIVE, 1), F.lit(""))
        unit = F.lower(F.rtrim(F.regexp_extract(s, RELATIVE, 2), F.lit("s")))
        parts = F.struct(number.try_cast("bigint").alias("n"), unit.alias("unit"))
        ago = F.when(s.rlike("^[+0-9-]"), let(parts, relative))
        return F.when(s.rlike("^[A-Za-z]"), day).otherwise(ago)

    return let(trim_space(text), parse)


def strip_date_prefix(
    snippet: Column, date_text: Column, parsed: Column, mode: str = "chars"
) -> Column:
    """Remove a leading date from a snippet whose date was understood.

    ``chars`` treats the date as a set of characters, so letters of the date at the
    start of the sentence go too; ``prefix`` removes the exact text only.
    """
    if mode not in ("chars", "prefix"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "chars":
        cut = F.ltrim(snippet, date_text)
    else:
        cut = F.when(
            F.startswith(snippet, date_text),
            F.substr(snippet, F.length(date_text) + F.lit(1)),
        ).otherwise(snippet)
    has_date = parsed.isNotNull() & (date_text != "")
    return F.when(has_date, F.ltrim(cut, F.lit(" -\n\t"))).otherwise(snippet)
