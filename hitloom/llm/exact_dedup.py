"""Exact duplicates by Grace hash deduplication over whole contents.

Records are dealt by a hash of their content into buckets of a spill table, a bucketed Parquet
table in the shared folder, and each bucket goes through an open-addressing table that compares
complete contents.  A bucket whose distinct contents would not fit is not opened: its records are
dealt again, by another hash and into more buckets, until every bucket fits.  Equal contents meet
in a table of the same kind in each task before they are spilled, so a content that fills a third
of the rows is spilled once per task and not once per row.

What leaves the tables is one narrow row per content: its digest, the row that stays and the size
of the group.  Rows find their group by the digest; a content that stands alone joins with nothing.

Results: the content is the text without the characters ``[\\x20\\x09-\\x0D]``, null being the
empty text, so null, empty and blank texts are one group.  Of a group the row with the most code
points in its original text stays, then the one with the smallest doc_id, a row without doc_id
last; of rows that are equal in both, one stays.  An empty table gives no rows.  Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.store import beside, saved
from hitloom.session import scratch_dir

# The characters that do not count.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of distinct contents that a bucket may hold, and that a task holds before it spills.
FIT_BYTES = 64 << 20
#: Files of one spill table; a file holds several buckets where there are more.
MAX_FILES = 20_000
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 4096


def content_of(text: str | None) -> bytes:
    return text.encode().translate(None, BLANKS) if text else b""


class ContentTable:
    """Open addressing with linear probing; a place holds the number of an entry, or -1."""

    def __init__(self, places: int = 1024):
        self.places = [-1] * places
        self.codes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def entry(self, content: bytes) -> tuple[int, bool]:
        """Number of the entry with exactly this content, and whether it is new."""
        code = xxhash.xxh64_intdigest(content)
        mask = len(self.places) - 1
        at = code & mask
        while (found := self.places[at]) >= 0:
            if self.codes[found] == code and self.contents[found] == content:
                return found, False
            at = (at + 1) & mask
        found = self.places[at] = len(self.codes)
        self.codes.append(code)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.codes) > len(self.places):
            self._grow()
        return found, True

    def _grow(self) -> None:
        self.places = [-1] * (2 * len(self.places))
        mask = len(self.places) - 1
        for number, code in enumerate(self.codes):
            at = code & mask
            while self.places[at] >= 0:
                at = (at + 1) & mask
            self.places[at] = number


def _better(a: tuple, b: tuple) -> tuple:
    """The better of two (code points, doc_id, rows that tie), ties added up."""
    if a[:2] == b[:2]:
        return (a[0], a[1], a[2] + b[2])
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    if a[1] is None or b[1] is None:
        return a if b[1] is None else b
    return a if a[1] < b[1] else b


class _Groups:
    """A content table with the number of rows and the best row of each entry."""

    def __init__(self):
        self.table, self.rows, self.best = ContentTable(), [], []

    def add(self, content: bytes, rows: int, best: tuple) -> None:
        entry, new = self.table.entry(content)
        if new:
            self.rows.append(rows)
            self.best.append(best)
        else:
            self.rows[entry] += rows
            self.best[entry] = _better(self.best[entry], best)

    def columns(self, at: slice) -> list[pa.Array]:
        best = self.best[at]
        return [
            pa.array(self.rows[at], pa.int64()),
            pa.array([b[0] for b in best], pa.int64()),
            pa.array([b[1] for b in best], pa.int64()),
            pa.array([b[2] for b in best], pa.int64()),
        ]


_BEST = "rows long, points long, doc_id long, ties long"
_NAMES = ["rows", "points", "doc_id", "ties"]


def _records(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, tuple]]:
    """(content, rows, best row) of each row of a batch of spilled records."""
    for content, *rest in zip(*(batch.column(c) for c in ["content", *_NAMES])):
        rows, points, doc_id, ties = (x.as_py() for x in rest)
        yield content.as_py(), rows, (points, doc_id, ties)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, tuple]]:
    for text, points, doc_id in zip(*(batch.column(c) for c in ["text", "points", "doc_id"])):
        yield content_of(text.as_py()), 1, (points.as_py(), doc_id.as_py(), 1)


def _dealt(read: Callable, level: int, buckets: int, fit: int) -> Callable:
    """Records to spill: equal ones of a task met, with the bucket that this level gives them."""

    def emptied(groups: _Groups) -> Iterator[pa.RecordBatch]:
        contents, codes, at = groups.table.contents, groups.table.codes, 0
        while at < len(contents):
            end, size = at, 0
            while end < len(contents) and end - at < _BATCH_ROWS and (end == at or size + len(contents[end]) <= _BATCH_BYTES):
                size += len(contents[end])
                end += 1
            own = contents[at:end]
            bucket = [xxhash.xxh64_intdigest(c, level + 1) % buckets for c in own]
            code = [c - (1 << 64) if c >> 63 else c for c in codes[at:end]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array(code, pa.int64()), pa.array([len(c) for c in own], pa.int64()),
                 pa.array(own, pa.binary()), *groups.columns(slice(at, end))],
                ["bucket", "code", "size", "content", *_NAMES],
            )
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()
        for batch in batches:
            for record in read(batch):
                groups.add(*record)
                if groups.table.bytes > fit:
                    yield from emptied(groups)
                    groups = _Groups()
        yield from emptied(groups)

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket through its table, batch by batch: a row per distinct content."""
    groups = _Groups()
    for batch in batches:
        for record in _records(batch):
            groups.add(*record)
    digests = [hashlib.sha256(c).digest() for c in groups.table.contents]
    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *groups.columns(slice(None))], ["digest", *_NAMES])


class Spill:
    """A spill table: records bucketed by ``bucket``, so that a bucket is read by one task without a shuffle."""

    def __init__(self, records: DataFrame, buckets: int, name: str):
        self.spark = records.sparkSession
        path = scratch_dir(self.spark, name)
        self.table = path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
        files = min(buckets, MAX_FILES)
        writer = records.repartition(files, "bucket").write.format("parquet").option("compression", "zstd")
        writer.bucketBy(files, "bucket").sortBy("bucket").option("path", path).saveAsTable(self.table)
        self.rows = self.spark.read.table(self.table)

    def drop(self) -> None:
        """Remove the table and its files."""
        files = self.rows.inputFiles()
        self.spark.sql(f"drop table {self.table}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in files}:
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(conf).delete(target, True)


def groups_of(docs: DataFrame, total_bytes: int, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(digest, rows, points, doc_id, ties) per distinct content of ``docs`` (doc_id, text, points).

    ``total_bytes`` sizes the first level only.
    """
    found, read, pending, level, spilled = [], _documents, docs, 0, None
    while True:
        buckets = max(1, 2 * -(-total_bytes // fit_bytes))
        spec = f"bucket long, code long, size long, content binary, {_BEST}"
        records = pending.mapInArrow(_dealt(read, level, buckets, fit_bytes), spec)
        spill = Spill(records, buckets, "spill")
        if spilled:
            spilled.drop()
        spilled, rows = spill, spill.rows
        sizes = rows.groupBy("bucket", "code").agg(F.max("size").alias("size"))
        sizes = sizes.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("contents"))
        over = saved(sizes.where((F.col("size") > fit_bytes) & (F.col("contents") > 1)), "over")
        total_bytes = over.agg(F.sum("size")).first()[0] or 0
        fits = beside(rows, over.select("bucket"), ["bucket"], "left_anti") if total_bytes else rows
        found.append(saved(fits.groupBy("bucket").applyInArrow(_settled, f"digest binary, {_BEST}"), "groups"))
        if not total_bytes:
            spilled.drop()
            break
        pending = beside(rows, over.select("bucket"), ["bucket"], "left_semi")
        read, level = _records, level + 1
    first, *more = found
    for other in more:
        first = first.unionByName(other)
    return first


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(content_of(t.as_py())).digest() for t in texts], pa.binary())


def exact_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_bytes: int = FIT_BYTES
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``df``."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    points = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")
    rows = docs.select("doc_id", points, size, F.arrow_udf(_digests, "binary")("text").alias("digest"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    groups = groups_of(docs.select("doc_id", "text", points), total, fit_bytes)
    copied = groups.where("rows > 1").select(
        "digest", F.col("rows").alias("group_size"), F.col("points").alias("most"), F.col("doc_id").alias("keep_id"), "ties"
    )
    joined = rows.select("doc_id", "points", "digest", "row").join(copied, "digest", "left")
    alone = F.col("group_size").isNull()
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
    kept = alone | best
    # Rows that are equal in doc_id and length: the first of them in the stored table stays.
    if copied.where("ties > 1").limit(1).count():
        tied = joined.where(best & (F.col("ties") > 1)).groupBy("digest").agg(F.min("row").alias("first"))
        joined = joined.join(tied.withColumnRenamed("digest", "tied"), F.col("digest") == F.col("tied"), "left")
        kept = kept & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
