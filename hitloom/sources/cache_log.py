"""TTL tables as a log of batches: appends only, merged on read, purged by partition.

A batch of entries is a folder ``batch=<n>``, dealt by the hour its rows expire in
(``expires_hour``).  The entry of a key is the rows of its latest batch.  What is written
follows the batch and never the table; writing a batch again replaces its own folder, so a
replayed batch changes nothing.  One stream (or one job) at a time numbers the batches.

Purging removes whole folders of past hours.  An expired entry may stand over an older one
that is still alive (a longer life, or none ending); a mark in the older one's hour then keeps
it hidden, and goes when it goes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.schemas import RESULT_CACHE

#: The hour of rows that never expire.
NEVER = 2_000_000_000
_PARTS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("expires_hour", T.LongType())])
_MARK = T.StructType([T.StructField("dropped", T.BooleanType())])


def _hour(expires_at):
    return F.when(expires_at > 0, F.floor(expires_at / 3600)).otherwise(NEVER).cast("long")


def append_entries(entries: DataFrame, root: str, batch: int, dropped: bool = False) -> None:
    """Write a batch of entries; those of ``dropped`` batches take their keys out of the table."""
    rows = entries.withColumn("dropped", F.lit(dropped))
    rows = rows.withColumn("expires_hour", _hour(F.coalesce("expires_at", F.lit(0))))
    rows.write.mode("overwrite").partitionBy("expires_hour").parquet(f"{root}/batch={batch}")


def log_rows(spark: SparkSession, root: str, schema: T.StructType = RESULT_CACHE) -> DataFrame:
    """All rows of the log, with ``batch``, ``expires_hour`` and ``dropped``; none on first use."""
    full = T.StructType([*schema.fields, *_MARK.fields, *_PARTS.fields])
    try:
        return spark.read.schema(full).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def read_log(spark: SparkSession, root: str, schema: T.StructType = RESULT_CACHE) -> DataFrame:
    """The table: of each key the rows of its latest batch, unless that dropped it."""
    rows = log_rows(spark, root, schema)
    last = rows.groupBy("cache_key").agg(F.max("batch").alias("_last"), F.max(F.struct("batch", "dropped"))["dropped"].alias("_gone"))
    current = rows.join(last.where("not _gone").drop("_gone"), "cache_key").where(F.col("batch") == F.col("_last"))
    return current.where("not dropped").select(*schema.fieldNames())


def _folders(spark: SparkSession, pattern: str) -> list:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(system, status.getPath()) for status in system.globStatus(path) or []]


def purge_log(spark: SparkSession, root: str, now: int, schema: T.StructType = RESULT_CACHE) -> int:
    """Remove the folders whose rows have all expired; returns how many went.

    Reads the keys of the past hours and of what they may hide, and no other column.  Safe to
    run again after it was cut short.
    """
    hour = now // 3600
    past = [
        (system, path) for system, path in _folders(spark, f"{root}/batch=*/expires_hour=*")
        if int(path.getName().split("=")[1]) < hour
    ]
    if not past:
        return 0
    rows = log_rows(spark, root, schema).select("cache_key", "batch", "expires_hour")
    gone = rows.where(F.col("expires_hour") < hour).groupBy("cache_key").agg(F.max("batch").alias("_gone"))
    kept = rows.where(F.col("expires_hour") >= hour).join(gone, "cache_key")
    kept = kept.groupBy("cache_key").agg(
        F.max("batch").alias("_newest"), F.max("_gone").alias("batch"), F.max("expires_hour").alias("expires_hour")
    )
    # Only where nothing newer stands over the older rows already.
    hidden = kept.where(F.col("_newest") < F.col("batch")).drop("_newest").withColumn("dropped", F.lit(True))
    if not hidden.isEmpty():
        hidden.write.mode("append").partitionBy("batch", "expires_hour").parquet(root)
    for system, path in past:
        system.delete(path, True)
    return len(past)
