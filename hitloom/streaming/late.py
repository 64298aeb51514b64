"""Records that wait for the capture of their page: a join of two streams.

Records and captures come in as two folders of parquet files. A record waits for captures
of its URL that were scraped from ``age`` seconds before it was queued to ``wait`` seconds
after; of those, the one scraped last counts, as in ``attach_pages``. When the watermark has
passed that time, the record leaves once, with its page or with the error that there is none.
A body is read once, in the batch it arrives with, and stays in the state only as long as
a record may still ask for it.

Each row of a stream must arrive within ``disorder`` seconds of the newest row of both streams
before it; Spark drops what comes later, so ``finished`` counts such rows and stops. The
watermark is that of the slower stream: one that has nothing to say sends a heartbeat, a row
that carries only its time.

- a record without a URL waits its time and leaves unchanged, spread over the tasks;
- equal records have different ids and leave one each; an id that comes twice leaves once;
- a record without an id or a time stops the stream, as it could never leave;
- a capture without a URL or a readable time answers nothing;
- empty folders give nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hitloom.operators.attach import apply_page, url_join_key
from hitloom.operators.records import RECORD_COLUMNS
from hitloom.schemas import RECORD, SNAPSHOT, TEXT
from hitloom.sources.ndjson import with_record_defaults
from hitloom.streaming.stages import write_record_stream

WAITING = T.StructType(
    [*RECORD.fields, T.StructField("record_id", TEXT), T.StructField("queued_at", T.TimestampType())]
)
#: The state lies outside the heap, without megabytes set aside for each of its many small stores.
#: A batch saves what it changed, so that a waiting body is written once, not with each batch.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_HEARTBEAT = "\1heartbeat"


def _seconds(n: int) -> Column:
    return F.expr(f"interval {int(n)} seconds")


def _spread(record_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(record_id), F.lit(salts)).cast("int")


def late_pages(
    records: DataFrame, captures: DataFrame, wait: int = 120, age: int = 0, disorder: int = 60,
    salts: int = 1,
) -> DataFrame:
    """Streams of ``WAITING`` records and ``SNAPSHOT`` captures to records with their pages.

    The columns are those of a record with record_id and queued_at. The join keeps its
    state by URL; where one URL may be asked by a large share of the records, ``salts`` deals
    them over that many tasks, at the price of as many copies of each body in the state.
    """
    known = F.col("record_id").isNotNull() & F.col("queued_at").isNotNull()
    checked = F.when(known, F.col("queued_at")).otherwise(
        F.raise_error(F.lit("a waiting record lacks record_id or queued_at")).cast("timestamp")
    )
    heartbeat = F.coalesce(F.col("record_id"), F.lit("")) == _HEARTBEAT
    waiting = (
        with_record_defaults(records)
        .withColumn("queued_at", checked)
        .withColumn("_key", url_join_key(["record_id"]))
        .withColumn("_salt", F.when(heartbeat, -1).otherwise(_spread(F.col("record_id"), salts)))
        .withWatermark("queued_at", f"{disorder} seconds")
    )
    found = captures.select(
        F.col("url").alias("_url"),
        F.try_to_timestamp("scraped_at").alias("_at"),
        F.struct("title", "raw_html", "scraped_at", "error", F.lit(False).alias("from_cache")).alias("_page"),
    )
    found = found.withWatermark("_at", f"{disorder} seconds").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_copy")
    )
    at, queued = F.col("_at"), F.col("queued_at")
    joined = waiting.join(
        found,
        (F.col("_key") == F.col("_url")) & (F.col("_salt") == F.col("_copy"))
        & (at >= queued - _seconds(age)) & (at <= queued + _seconds(wait)),
        "left",
    )
    # Naming the time keeps this filter above the watermark, which heartbeats must reach.
    said = ~heartbeat | queued.isNull()
    row = F.struct(*RECORD_COLUMNS)
    newest = F.when(F.col("_url").isNotNull(), F.struct(at, F.col("_page")))
    picked = (
        joined.where(said).groupBy("queued_at", "record_id")
        .agg(F.min(row).alias("_row"), F.max(newest).alias("_newest"))
    )
    rows = picked.select("record_id", "queued_at", "_row.*", F.col("_newest._page").alias("_page"))
    return apply_page(rows, [*RECORD_COLUMNS, "record_id", "queued_at"], reset_error=False)


def stream_late_pages(
    spark: SparkSession, records: str, captures: str, sink: str, checkpoint: str,
    wait: int = 120, age: int = 0, disorder: int = 60, salts: int = 1,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Folders of waiting records and of captures in, record files out.

    A run takes what has arrived, then stops; records that still wait are kept in the state
    for the next run. The state, which holds bodies, is kept outside the heap and saved with
    the checkpoint, so a lost executor or a restart loses none.
    """

    def files(path: str, schema: T.StructType) -> DataFrame:
        return (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
        )

    out = late_pages(files(records, WAITING), files(captures, SNAPSHOT), wait, age, disorder, salts)
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        return write_record_stream(out, sink, checkpoint, keep_raw=True)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_heartbeats(spark: SparkSession, at: dt.datetime, records: str, captures: str) -> None:
    """Tell both streams that nothing older than ``at`` (with its zone) comes any more."""
    record = {"record_id": _HEARTBEAT, "queued_at": at}
    row = tuple(record.get(name) for name in WAITING.fieldNames())
    spark.createDataFrame([row], WAITING).coalesce(1).write.mode("append").parquet(records)
    text = at.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    capture = (_HEARTBEAT, None, None, text, None)
    spark.createDataFrame([capture], SNAPSHOT).coalesce(1).write.mode("append").parquet(captures)


def finished(query: StreamingQuery) -> StreamingQuery:
    """Wait for the end of a run; stop if rows came too late to be joined, so none is lost unseen."""
    query.awaitTermination()
    operators = [op for progress in query.recentProgress for op in progress.stateOperators]
    late = sum(op.numRowsDroppedByWatermark for op in operators)
    if late:
        raise ValueError(f"{late} rows came later than the disorder allowed")
    return query
