"""Captured pages and TTL tables kept as parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.schemas import RESULT_CACHE, RESULT_PAGE, SNAPSHOT


def _read(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None) -> DataFrame:
    scan = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    return scan.repartition(partitions) if partitions else scan


def save_result_pages(result_pages: DataFrame, path: str, mode: str = "append") -> None:
    """Keep engine pages in one folder per page number, so that a page limit skips whole folders.

    Few results are asked for beyond the first page, and a limit is the one filter every
    search has. Files follow the tasks of ``result_pages``: nothing is moved to write them.
    """
    result_pages.select(*RESULT_PAGE.fieldNames()).write.mode(mode).partitionBy("page").parquet(path)


def read_result_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Captured engine pages: query_id, engine, page, http_status, html.

    ``path`` holds plain files or the folders of ``save_result_pages``.
    ``partitions`` deals the rows out anew, for a table of a few large splits; the size of
    splits is set by ``spark.sql.files.maxPartitionBytes``.
    """
    return _read(spark, path, RESULT_PAGE, partitions)


def read_snapshots(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Captured page bodies: url, title, raw_html, scraped_at, error."""
    return _read(spark, path, SNAPSHOT, partitions)


def save_snapshots(
    snapshots: DataFrame, table: str, buckets: int, mode: str = "overwrite", path: str | None = None
) -> None:
    """Keep bodies bucketed and sorted by URL, so that joins on it do not move them.

    The table lies in the warehouse, or at ``path``; it is read with ``spark.table``.
    """
    writer = snapshots.write.mode(mode).bucketBy(buckets, "url").sortBy("url").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _version_log(root: str) -> str:
    return f"{root.rstrip('/')}/versions"


def _version_dir(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/data/v{version:012d}"


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the last committed version; 0 when there is none."""
    try:
        log = spark.read.schema("version BIGINT").json(_version_log(root))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise
    return log.agg(F.max("version")).first()[0] or 0


def commit_version(table: DataFrame, root: str) -> int:
    """Write the table as a new version, then record its number.

    What is being read is never overwritten. A job lost before the number is
    recorded leaves a folder nobody reads; the next commit replaces it. One writer
    at a time.
    """
    spark = table.sparkSession
    version = latest_version(spark, root) + 1
    table.write.mode("overwrite").parquet(_version_dir(root, version))
    mark = spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
    mark.write.mode("append").json(_version_log(root))
    return version


def read_cache(
    spark: SparkSession, root: str, schema: T.StructType = RESULT_CACHE
) -> DataFrame:
    """The last committed version; the empty table on first use."""
    version = latest_version(spark, root)
    if version == 0:
        return spark.createDataFrame([], schema)
    table = spark.read.parquet(_version_dir(root, version))
    missing = set(schema.fieldNames()) - set(table.columns)
    if missing:
        raise ValueError(f"cache at {root} lacks columns {sorted(missing)}")
    return table.select(*schema.fieldNames())


def clear_cache(spark: SparkSession, root: str, schema: T.StructType = RESULT_CACHE) -> int:
    """Commit the empty version, so that no entry answers any more; also where there is no table yet."""
    return commit_version(spark.createDataFrame([], schema), root)
