"""Intermediate tables in the shared folder, and joins with sides of a checked size."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.session import scratch_dir


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table that ``saved`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def beside(df: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = 100_000) -> DataFrame:
    """Join with a table that is usually small: broadcast at ``max_rows`` rows or fewer, else shuffled."""
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return df.join(small, on, how)


_BUILT: dict[str, object] = {}


def _built(key: str, sent, build: Callable):
    if key not in _BUILT:
        _BUILT.clear()  # workers outlive a stage: what the one before used goes
        _BUILT[key] = build(sent.value)
    return _BUILT[key]


def on_workers(spark: SparkSession, payload, build: Callable) -> Callable:
    """A function that gives ``build(payload)``, built once per worker and stage.

    ``payload`` is broadcast, so callers pass only what has a bounded size.
    """
    return partial(_built, uuid.uuid4().hex, spark.sparkContext.broadcast(payload), build)
