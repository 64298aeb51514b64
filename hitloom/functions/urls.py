"""URL expressions: split, normalize, escape, resolve. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitloom.functions.text import let

# Groups: 1 scheme, 2 "//authority", 3 authority, 4 path, 5 "?query", 6 "#fragment".
URL_PATTERN = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
)


def _parts(url: Column) -> Column:
    """The pieces of a URL as a struct."""

    def part(n: int) -> Column:
        return F.regexp_extract(url, URL_PATTERN, n)

    authority = part(3)
    return F.struct(
        part(1).alias("scheme"),
        part(2).alias("slashes"),
        F.regexp_extract(authority, r"(?s)^(.*)@", 1).alias("user"),
        F.regexp_extract(authority, r"(?s)^(?:.*@)?(.*)$", 1).alias("host"),
        part(4).alias("path"),
        part(5).alias("query"),
        part(6).alias("fragment"),
    )


def _is_valid(url: Column, p: Column) -> Column:
    """False for text a strict URL parser rejects: such text is never rewritten."""
    host, path = p["host"], p["path"]
    escaped = F.concat(host, path, p["fragment"])
    unescaped = F.regexp_replace(escaped, "%[0-9A-Fa-f]{2}", "")
    return ~(
        url.rlike(r"^:|[\x00-\x1f\x7f]")
        | ((p["scheme"] == "") & (p["slashes"] == "") & path.rlike("^[^/]*:"))
        # Forbidden signs, an escape of a plain character, an open bracket, a bad port.
        | host.rlike(r"[ \\^`{|}]|^\[[^\]]*$|:[^:\]0-9]*[^:\]0-9][^:\]]*$|:[0-9]+[^:\]0-9][^:\]]*$")
        | (host.rlike("%[0-7]") & ~F.contains(host, F.lit("%25")))
        | p["user"].rlike(r"[^A-Za-z0-9\-._:~!$&'()*+,;=%@]")
        | F.contains(unescaped, F.lit("%"))
    )


def url_host(url: Column) -> Column:
    """Host with port; empty when there is none, null when the URL is not valid."""
    return let(_parts(url), lambda p: F.when(_is_valid(url, p), p["host"]))


# What form encoding and path encoding write differently.
_PATH_SAFE = [
    ("+", "%20"), ("*", "%2A"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","),
    ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%7E", "~"),
]


def _encode_path(path: Column) -> Column:
    """Decode percent escapes, then escape again in the canonical form for paths."""
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    out = F.url_encode(plain)
    for old, new in _PATH_SAFE:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.coalesce(out, path)


def _normal_path(path: Column) -> Column:
    """Drop one trailing slash; re-encode only where the text needs it."""
    trimmed = F.regexp_replace(path, "/$", "")
    odd = trimmed.rlike(r"[^A-Za-z0-9\-._~$&+,/:;=@]")
    unwritable = path.rlike(r"[^A-Za-z0-9\-._~$&+,/:;=@!'()*\[\]%]")
    rewrite = odd & (F.endswith(path, F.lit("/")) | unwritable)
    return F.when(rewrite, _encode_path(trimmed)).otherwise(trimmed)


# A URL with nothing to check and nothing to encode. Groups: 1 scheme, 2 host and port
# without "www.", 3 path without one trailing slash, 4 query.
PLAIN_URL = (
    r"^([a-z][a-z0-9+.\-]*://)(?:[Ww]{3}\.)?+([A-Za-z0-9.\-]+(?::[0-9]*)?)"
    r"((?:/[A-Za-z0-9\-._~$&+,/:;=@]*?)??)/?(\?[^#\x00-\x1f\x7f]*)?(?:#[^%\x00-\x1f\x7f]*)?$"
)


def _normalize_any(url: Column) -> Column:
    def rebuild(p: Column) -> Column:
        path = p["path"]
        host = F.regexp_replace(F.lower(p["host"]), r"^www\.", "")
        opaque = (p["scheme"] != "") & (p["slashes"] == "") & ~F.startswith(path, F.lit("/"))
        rebuilt = F.concat(
            F.when(p["scheme"] != "", F.concat(F.lower(p["scheme"]), F.lit(":"))).otherwise(""),
            F.when((p["slashes"] != "") & (F.concat(p["user"], host, path) != ""), "//").otherwise(""),
            F.when(p["user"] != "", F.concat(p["user"], F.lit("@"))).otherwise(""),
            host,
            F.when(opaque, path).otherwise(_normal_path(path)),
            p["query"],
        )
        return F.when(_is_valid(url, p), rebuilt).otherwise(url)

    return let(_parts(url), rebuild)


def normalize_url(url: Column) -> Column:
    """Merge key of a hit.

    The host is lowercased and loses one leading ``www.``, the path loses one
    trailing slash, the fragment goes. Scheme, user info, port and query stay.
    Text that is not a valid URL is returned as it is. A plain URL takes one
    regular expression; the full rules run on the others only.
    """
    def lowered(split: Column) -> Column:
        host = F.substring_index(F.substring_index(split, "\0", 2), "\0", -1)
        plain = F.concat(
            F.substring_index(split, "\0", 1), F.lower(host), F.substring_index(split, "\0", -1)
        )
        return F.when(split != url, plain).otherwise(_normalize_any(url))

    return let(F.regexp_replace(url, PLAIN_URL, "$1\0$2\0$3$4"), lowered)


def query_escape(text: Column) -> Column:
    """Percent-encode a query value: space to ``+``, tilde kept, asterisk escaped."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def absolute_url(src: Column, origin: Column | str) -> Column:
    """Prefix the site origin to a path that starts with a slash."""
    base = F.lit(origin) if isinstance(origin, str) else origin
    return F.when(F.startswith(src, F.lit("/")), F.concat(base, src)).otherwise(src)
