import gzip
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from hitloom.llm import warc

BIG = "<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5
ROWS = [
    (7, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (None, "http://a/3", BIG), (3, "http://a/2", BIG),
    (1, "http://x/\r\nWARC-Type: evil", "small"), (2, "u", "small"), (4, "u", None), (5, "u", ""), (6, "u", "y" * 99),
    (8, "u", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (None, "u", "w" * 300), (None, "u", "w" * 300), (12, "u", "v" * 200_000),
]


def brute(rows):
    least = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= 100 and page is not None:
            least[html] = min(least.get(html, page), page)
    out = []
    for page, _, html in rows:
        raw, first = (html or "").encode(), least.get(html)
        revisit = first is not None and (page is None or page > first)
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, digest int, kind string")
    for size in (1, warc.ARCHIVE_BYTES):
        path = str(tmp_path / f"warc{size}")
        warc.write(df.repartition(3), path, archive_bytes=size)
        records = warc.read_records(spark, path, with_payload=True).cache()
        assert records.count() == 3 * len(ROWS)
        assert records.select("id").distinct().count() == 3 * len(ROWS)
        found = warc.resolved(warc.transactions(records)).collect()
        got = Counter(
            (
                int(r.metadata.page_id) if r.metadata.page_id else None,
                r.payload_bytes,
                r.payload_sha256 or r.digest,
                r.kind,
                r.refers_page,
            )
            for r in found
        )
        assert got == brute(ROWS)
        assert all(r.request.uri == r.uri for r in found)
        assert {bytes(r.payload).decode() for r in found if r.kind == "response"} == {html or "" for _, _, html in ROWS}
        known = {r.id for r in found if r.kind == "response" and r.metadata.page_id == "10"}
        assert {r.refers_to for r in found if r.metadata.page_id == "11"} == known


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    assert warc.transactions(warc.read_records(spark, str(tmp_path / "w"))).count() == 0


def test_archives_are_plain_warc(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS[:2], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    (name,) = (tmp_path / "w").glob("part-*")
    raw = gzip.decompress(name.read_bytes())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    kinds = [h["warc-type"] for h, _ in warc.parse(raw)]
    assert kinds == ["request", "revisit", "metadata", "request", "response", "metadata"]


def test_lone_records(spark):
    rows = [("response", "a", None, None), ("request", "b", "zz", None), ("metadata", "c", "a", "5")]
    df = spark.createDataFrame(rows, "kind string, id string, concurrent_to string, page_id string").withColumn("uri", F.lit("u"))
    (row,) = warc.transactions(df).collect()
    assert (row.id, row.request, row.metadata.page_id) == ("a", None, "5")
