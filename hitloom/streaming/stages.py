"""The pipe stages as Structured Streaming jobs.

Each stage applies the batch operator to a stream of record files. Both are
stateless, so a restart only needs the checkpoint folder.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hitloom.operators.attach import attach_pages
from hitloom.operators.cache import latest_entries
from hitloom.operators.records import record_json
from hitloom.operators.sanitize import MAX_CHARS, sanitize
from hitloom.schemas import RECORD, RESULT_CACHE
from hitloom.sources.cache_log import append_entries, purge_log
from hitloom.sources.ndjson import with_record_defaults


def read_record_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int = 1000
) -> DataFrame:
    """New record files of a folder; a malformed line stops the stream."""
    rows = (
        spark.readStream.schema(RECORD)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(path)
    )
    return with_record_defaults(rows)


def write_record_stream(
    records: DataFrame, path: str, checkpoint: str, keep_raw: bool = False
) -> StreamingQuery:
    """Append records as JSON lines, take what is there, then stop."""
    return (
        records.select(record_json(keep_raw).alias("value"))
        .writeStream.format("text")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def stream_sanitize(
    spark: SparkSession, source: str, sink: str, checkpoint: str,
    max_chars: int = MAX_CHARS, keep_raw: bool = False, extractor=None, unit: str = "bytes",
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Record files in, sanitized record files out; skipped rows keep their HTML."""
    strip = "none" if keep_raw else "sanitized"
    records = read_record_stream(spark, source, max_files_per_trigger)
    out = sanitize(records, max_chars, extractor, strip, unit)
    return write_record_stream(out, sink, checkpoint, keep_raw=True)


def stream_attach_pages(
    spark: SparkSession, source: str, snapshots: DataFrame, sink: str, checkpoint: str,
    cache: DataFrame | None = None, now: int | None = None, max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Record files in, records with page bodies out: a stream-static left join.

    Each micro-batch reads the bodies once, so keep batches large; bodies bucketed
    by URL (``save_snapshots``) are not shuffled for it.
    """
    records = read_record_stream(spark, source, max_files_per_trigger)
    out = attach_pages(records, snapshots, cache, now)
    return write_record_stream(out, sink, checkpoint, keep_raw=True)


def stream_cache_upkeep(
    entries: DataFrame, root: str, checkpoint: str,
    schema: T.StructType = RESULT_CACHE, version: str | None = None, now: int | None = None,
) -> StreamingQuery:
    """Append each micro-batch of entries to the log at ``root``, then purge the hours that passed.

    A batch writes its own rows only, whatever the size of the table; a replayed batch
    replaces its own folder. The table is read with ``read_log``. ``version`` orders
    repeated writes of one key within a batch. One stream, with its checkpoint, owns a log.
    """

    def upkeep(batch: DataFrame, batch_id: int) -> None:
        new = latest_entries(batch, version) if version else batch
        append_entries(new.select(*schema.fieldNames()), root, batch_id)
        purge_log(batch.sparkSession, root, int(time.time()) if now is None else now, schema)

    return (
        entries.writeStream.foreachBatch(upkeep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
