"""Text expressions: trimming, cutting, quoting, entities, exact number formatting."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trim_space(text: Column) -> Column:
    """Trim every Unicode space, where the built-in trim takes blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quote_bangs(query: Column) -> Column:
    """Quote every token that starts with ``!`` and goes on: ``!g`` becomes ``'!g'``."""
    return F.regexp_replace(query, r"(^|[ \t])(![^ \t]+)", "$1'$2'")


def _byte_prefix(text: Column, n: int) -> Column:
    return F.substring(text.cast("binary"), 1, n).cast("string")


def truncate_text(text: Column, limit: int, unit: str = "bytes") -> Column:
    """Cut to ``limit`` bytes or characters; 0 means no cut.

    A byte cut may fall inside a character: each leftover byte then becomes U+FFFD.
    """
    if unit not in ("bytes", "chars"):
        raise ValueError(f"unknown unit {unit!r}")
    if limit <= 0:
        return text
    if unit == "chars":
        return F.left(text, F.lit(limit))

    def cut(t: Column) -> Column:
        whole = F.coalesce(
            *[F.try_validate_utf8(_byte_prefix(t, max(limit - k, 0))) for k in range(4)]
        )
        padded = let(whole, lambda w: F.concat(w, F.repeat(F.lit("�"), F.lit(limit) - F.octet_length(w))))
        return F.when(F.octet_length(t) > limit, padded).otherwise(t)

    return let(text, cut)


def ellipsize(text: Column, width: int) -> Column:
    """Text over ``width`` characters keeps the first ``width - 3`` and gets ``...``."""
    cut = F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))
    return F.when(F.length(text) > width, cut).otherwise(text)


def format_cents(value: Column) -> Column:
    """``%.2f`` of a non-negative double, rounded from its exact binary value.

    Java's formatter rounds the shortest decimal text instead. Where twice the
    value in cents looks like an odd whole number, the sign of the true remainder
    decides; it comes from an error-free product of the double's two halves.
    """
    twice = value * F.lit(200.0)
    near = F.round(twice)
    big = value * F.lit(134217729.0)
    high = big - (big - value)
    error = (high * F.lit(200.0) - twice) + (value - high) * F.lit(200.0)
    offset = (twice - near) + error
    half = F.floor(near / F.lit(2.0))
    tie = (F.abs(offset) < 1e-6) & (near % F.lit(2.0) == 1.0)
    up = (offset > 0) | ((offset == 0) & (half % F.lit(2) == 1))
    cents = (
        F.when(tie & up, half + F.lit(1))
        .when(tie, half)
        .otherwise(F.round(value * F.lit(100.0)).cast("long"))
    )
    return F.concat(
        F.floor(cents / F.lit(100)).cast("string"),
        F.lit("."),
        F.lpad((cents % F.lit(100)).cast("string"), 2, "0"),
    )


# Entities that end with a semicolon, and those that do without. The ampersand's own
# comes last, so that "&amp;lt;" reads "&lt;".
ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]+|#[0-9]+|#[xX][0-9A-Fa-f]+);"
BARE_ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]+|#[0-9]+|#[xX][0-9A-Fa-f]+)(?![A-Za-z0-9;])"
AMPERSAND = r"&(?:amp|AMP|#0*38|#[xX]0*26);?"
# Numbers 128 to 159 mean the characters of Windows-1252; five have none there.
WINDOWS_1252 = {
    code: ord(bytes([code]).decode("cp1252", "ignore")) for code in range(128, 160) if bytes([code]).decode("cp1252", "ignore")
}


def _entity_char(entity: Column) -> Column:
    """The text an entity stands for; null when it is unknown or the ampersand.

    Without a semicolon only the old names count. A number beyond the characters gives
    U+FFFD, as in a browser; zero stays as it is.
    """
    # One text, so the optimizer makes it a constant: nothing is built per row.
    known = "\x02".join(f"&{name}\x01{text}" for name, text in html5.items() if text != "&")
    named = F.try_element_at(F.str_to_map(F.lit(known), F.lit("\x02"), F.lit("\x01")), entity)
    digits = F.regexp_extract(entity, "^&#[xX]?0*([A-Fa-f0-9]*);?$", 1)
    hexadecimal = entity.rlike("^&#[xX]")
    # A code point has at most six hexadecimal and seven decimal digits, after zeros.
    code = F.when(
        F.length(digits) <= 7, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.nullif(digits, F.lit("")))
    ).cast("long")
    old = F.map_from_arrays(*[F.array(*map(F.lit, xs)) for xs in zip(*WINDOWS_1252.items())])

    def char(n: Column) -> Column:
        valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        known_code = F.coalesce(F.when(n.between(128, 159), F.try_element_at(old, n.cast("int"))), n)
        text = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, known_code)), 8, "0")), "UTF-32")
        return F.when(~n.isin(0, 38), F.coalesce(text, F.lit("\ufffd")))

    beyond = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(F.lit(0))
    number = let(F.coalesce(code, beyond.cast("long")), char)
    return F.when(entity.rlike("^&#"), number).otherwise(named)


def decode_entities(text: Column) -> Column:
    """Decode named and numeric character references in one pass over each distinct one."""

    def decode(t: Column) -> Column:
        found = F.concat(
            *[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (ENTITY, BARE_ENTITY)]
        )
        decoded = F.aggregate(
            F.array_distinct(found),
            t,
            lambda acc, e: F.replace(acc, e, F.coalesce(_entity_char(e), e)),
        )
        plain = F.regexp_replace(decoded, AMPERSAND, "&")
        return F.when(F.contains(t, F.lit("&")), plain).otherwise(t)

    return let(text, decode)


def longest_of(text: Column, order: Column) -> Column:
    """Aggregate: the longest value by bytes; the earliest in ``order`` wins a tie."""
    return F.max(F.struct(F.octet_length(text).alias("n"), (-order).alias("o"), text.alias("v")))["v"]


def merge_shadow_text(raw_html: Column, shadow_text: Column) -> Column:
    """Put non-empty shadow text before the last ``</html>``; what follows it is dropped."""
    head = F.regexp_extract(raw_html, r"(?s)^(.*)</html>", 1)
    block = F.concat(
        F.lit("\n<!-- shadow-dom-content -->\n<pre>"),
        shadow_text,
        F.lit("</pre>\n\n</body></html>"),
    )
    apply = (F.coalesce(shadow_text, F.lit("")) != "") & F.contains(raw_html, F.lit("</html>"))
    return F.when(apply, F.concat(head, block)).otherwise(raw_html)
