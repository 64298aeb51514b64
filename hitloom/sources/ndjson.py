"""Records as newline-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.operators.records import record_json
from hitloom.schemas import EMPTY_RECORD_VALUES, RECORD

CORRUPT = "_corrupt_record"


def with_record_defaults(records: DataFrame) -> DataFrame:
    """A key missing from a line takes its type's empty value; nullable fields stay null."""
    filled = records.fillna(EMPTY_RECORD_VALUES)
    empty = F.array().cast("array<string>")
    return filled.withColumn("engines", F.coalesce(F.col("engines"), empty))


def read_records(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """Records of a file or folder; blank lines are skipped, unknown keys ignored.

    ``failfast`` stops at a malformed line. ``quarantine`` keeps going and adds
    ``_corrupt_record``: the text of a malformed line, null on good rows.
    """
    if mode == "failfast":
        rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
        return with_record_defaults(rows)
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    schema = T.StructType([*RECORD.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).filter(F.trim("value", F.lit(" \t\r")) != "")
    parsed = lines.select(F.from_json("value", schema, options).alias("r")).select("r.*")
    return with_record_defaults(parsed)


def write_records(
    records: DataFrame, path: str, mode: str = "overwrite", keep_raw: bool = False
) -> None:
    """One JSON object per line with explicit nulls; a null raw_html is left out.

    The number of files follows the partitions: nothing is gathered into one.
    """
    lines = records.select(record_json(keep_raw).alias("value"))
    lines.write.mode(mode).text(path)
