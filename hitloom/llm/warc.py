"""WARC archives of page captures: write them, read them back, assemble the transactions.

A capture is three records: the request, the response (or a revisit of an equal payload) and
metadata; request and metadata name the response in WARC-Concurrent-To.  Spark's text writer
writes them, with the end of a record as line separator, so any store and any retry of a task
will do.  Reading parses whole archives of bounded size and joins the records of a capture
through their identifiers into one nested row.

Results: of payloads with ``REVISIT_BYTES`` or more that are equal, the one with the smallest
page_id is the response and the others revisit it; smaller ones are responses all.  A null
html is an empty payload; a null url has no target; a page without page_id never is the
response that others revisit (where none has an id, all are responses); a repeated row is a
capture of its own, and a response where its page_id is the smallest; line ends in a url are
percent-encoded; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.store import beside, saved

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str | Column, ident: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record; headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [("WARC-Type", kind), ("WARC-Record-ID", ident), *headers]
    text = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("") for k, v in lines]
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit("WARC/1.1\r\n"), *text, F.lit("Content-Length: "), size, F.lit(END), block)


def _urn(*parts: Column) -> Column:
    """A record id from what is distinct about the record."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    places = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in places]), F.lit(">"))


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, bytes, kind, first, salt) per page; html is null for revisits.

    Digests and ids alone find out which page revisits which; payloads stay where they are
    unless more digests are shared than ``beside`` broadcasts.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long")})
    keys = saved(rows.select("page_id", "digest", "bytes"), "payloads")
    shared = keys.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = saved(shared.where("n > 1").drop("n"), "shared")
    again = saved(keys.groupBy("page_id", "digest").count().where("count > 1").select("page_id", "digest", F.lit(True).alias("again")), "again")
    rows = beside(beside(rows, shared, ["digest"], "left"), again, ["page_id", "digest"], "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    unique = F.col("page_id").isNotNull() & F.col("again").isNull()
    return rows.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("html")).alias("html"),
        "digest",
        "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first")).alias("first"),
        F.when(unique, "").otherwise(F.monotonically_increasing_id().cast("string")).alias("salt"),
    )


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write gzip archives of about ``archive_bytes`` each to ``path``."""
    found = captures(pages)
    sizes = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    per_file = max(1, archive_bytes // (1000 + (sizes[1] or 0) // max(1, sizes[0])))
    own = lambda kind: _urn(F.lit(kind), F.col("page_id").cast("string"), F.col("digest"), F.col("salt"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    with_response = [*common, ("WARC-Concurrent-To", own("response"))]
    request = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}"))
    header = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    revisits = F.when(F.col("kind") == "revisit", F.lit(PROFILE))
    refers = F.when(revisits.isNotNull(), _urn(F.lit("response"), F.col("first").cast("string"), F.col("digest"), F.lit("")))
    response = [*common, digest, ("WARC-Profile", revisits), ("WARC-Refers-To", refers), ("Content-Type", F.lit("application/http; msgtype=response"))]
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    records = [
        _record("request", own("request"), [*with_response, ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        _record(F.col("kind"), own("response"), response, F.concat(header, F.coalesce("html", F.lit("")))),
        _record("metadata", own("metadata"), [*with_response, ("Content-Type", F.lit("application/warc-fields"))], fields),
    ]
    lines = found.select(F.concat_ws(END, *records).alias("value"))
    lines.write.option("maxRecordsPerFile", per_file).option("lineSep", END).option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an uncompressed archive."""
    at, end = 0, END.encode()
    while at < len(archive):
        stop = archive.index(end, at)
        lines = archive[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = stop + 4
        at = start + int(headers["content-length"])
        yield headers, archive[start:at]
        if archive[at : at + 4] != end:
            raise ValueError(f"the record before byte {at} has no end")
        at += 4


_RECORD = (
    "kind string, id string, concurrent_to string, uri string, date string, refers_to string, digest string,"
    " payload_bytes long, payload_sha256 string, page_id string, payload binary"
)
_NAMES = [field.split()[0] for field in _RECORD.split(",")]
_TYPES = [pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string() for n in _NAMES]


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, get = headers["warc-type"], headers.get
    size = sha = page = payload = None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(END.encode())
        size = int(head.lower().rpartition(b"content-length:")[2].split()[0])
        if kind == "response":
            if len(payload) != size:
                raise ValueError(f"payload of {get('warc-record-id')}: {len(payload)} bytes, not {size}")
            sha = hashlib.sha256(payload).hexdigest()
    elif kind == "metadata":
        page = block.decode().partition("pageId:")[2].strip() or None
    digest = (get("warc-payload-digest") or "").removeprefix("sha256:") or None
    refers = get("warc-refers-to")
    return (kind, get("warc-record-id"), get("warc-concurrent-to"), get("warc-target-uri"), get("warc-date"), refers, digest,
            size, sha, page, payload if with_payload else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for headers, block in parse(zlib.decompress(content.as_buffer(), 31)):
                    held.append(_row(headers, block, with_payload))
                    size += len(block) * with_payload + 500
                    if size > 4 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata.

    A request or metadata record without its response is left out, and a response without
    them has nulls there.
    """
    answers = records.where("kind in ('response', 'revisit')").drop("concurrent_to", "page_id")
    requests = records.where("kind = 'request'").select(
        F.col("concurrent_to").alias("id"), F.struct(F.col("id").alias("record_id"), "uri").alias("request")
    )
    metadata = records.where("kind = 'metadata'").select(
        F.col("concurrent_to").alias("id"), F.struct(F.col("id").alias("record_id"), "page_id").alias("metadata")
    )
    return answers.join(requests, "id", "left").join(metadata, "id", "left")


def resolved(found: DataFrame) -> DataFrame:
    """``found`` with ``refers_page``: the page_id of the response with the payload of a revisit."""
    page = F.col("metadata.page_id").cast("long")
    revisited = found.where("kind = 'revisit'").select("digest").distinct()
    answers = found.where("kind = 'response'").join(revisited, "digest", "left_semi")
    owners = answers.groupBy("digest").agg(F.min(page).alias("owner"))
    refers = F.when(F.col("kind") == "revisit", F.col("owner")).alias("refers_page")
    return beside(found, saved(owners, "owners"), ["digest"], "left").select(*found.columns, refers)
