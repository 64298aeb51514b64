"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows of equal text form a group that stays together.  A partial partition is a vector of one
load per shard; the two with the largest spread (largest load less smallest) are combined in
opposite order, heavy onto light, until one is left.  Groups are differenced in buckets, one
task each, and the partial partitions of the buckets again in buckets, until one is left; so
a task never holds more than a bucket, and each group finds its shard by following its way
down the levels.

Results: a null text has 0 bytes, as the empty one, and forms a group of its own; a row
counts its bytes plus one; repeated rows each get a slot; ties go by the group's key; an
empty table gives no rows; a group larger than a shard's share fills a shard of its own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitloom.llm.store import beside, saved

BUCKET = 20_000


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of loads per shard) into one.

    Returns the loads of the result, and for each row and shard the shard of the result that
    it became.  The two of largest spread meet first; ties go to the earlier row.
    """
    n, shards = loads.shape
    nodes, heap = [], []

    def push(values: list[tuple[int, tuple]]) -> None:
        values.sort(key=lambda x: -x[0])
        nodes.append(values)
        heapq.heappush(heap, (values[-1][0] - values[0][0], len(nodes) - 1))

    # A shard of a node: its load, and the (node, place) pairs it was made of.
    for row in loads.tolist():
        push([(load, (s,)) for s, load in enumerate(row)])
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        left, right = nodes[a], nodes[b]
        last = shards - 1
        push([(left[i][0] + right[last - i][0], (a, i, b, last - i)) for i in range(shards)])
    top = heap[0][1]
    place = {top: list(range(shards))}
    became = np.zeros((n, shards), np.int32)
    for node in range(len(nodes) - 1, -1, -1):
        own = place.pop(node)
        for (_, source), shard in zip(nodes[node], own):
            if node < n:
                became[node, source[0]] = shard
            else:
                a, i, b, j = source
                place.setdefault(a, [0] * shards)[i] = shard
                place.setdefault(b, [0] * shards)[j] = shard
    return np.array([load for load, _ in nodes[top]], np.int64), became


def _groups(shards: int):
    """One bucket of groups (key, size): (bucket, loads) and the shard of each group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending")])
        loads = np.zeros((len(table), shards), np.int64)
        loads[:, 0] = table["size"].to_numpy()
        total, became = difference(loads)
        return pa.table(
            {
                "key": table["key"],
                "bucket": table["bucket"],
                "shard": pa.array(became[:, 0]),
                "loads": pa.array([total.tolist()] * 1 + [None] * (len(table) - 1), pa.list_(pa.int64())),
            }
        )

    return run


def _partitions(table: pa.Table) -> pa.Table:
    """Partial partitions of one upper bucket: what each of their shards became, and the loads."""
    table = table.sort_by("id")
    loads = np.array(table["loads"].to_pylist(), np.int64)
    total, became = difference(loads)
    return pa.table(
        {
            "id": table["id"],
            "bucket": table["bucket"],
            "became": pa.array(became.tolist(), pa.list_(pa.int32())),
            "loads": pa.array([total.tolist()] + [None] * (len(table) - 1), pa.list_(pa.int64())),
        }
    )


def assign_groups(groups: DataFrame, shards: int, bucket: int = BUCKET) -> DataFrame:
    """(key, shard) for groups (key, size) with unique keys."""
    buckets = max(1, -(-groups.count() // bucket))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    schema = "key string, bucket long, shard int, loads array<long>"
    now = saved(dealt.groupBy("bucket").applyInArrow(_groups(shards), schema), "partial")
    found = now.select("key", F.col("bucket").alias("id"), "shard")
    parts = now.where("loads is not null").select(F.col("bucket").alias("id"), "loads")
    while buckets > 1:
        buckets = -(-buckets // bucket)
        upper = parts.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
        schema = "id long, bucket long, became array<int>, loads array<long>"
        step = saved(upper.groupBy("bucket").applyInArrow(_partitions, schema), "partial")
        parts = step.where("loads is not null").select(F.col("bucket").alias("id"), "loads")
        moves = step.select("id", F.col("bucket").alias("up"), "became")
        found = beside(found, moves, ["id"], "inner").select(
            "key", F.col("up").alias("id"), F.get("became", F.col("shard")).alias("shard")
        )
    return found.select("key", "shard")


def _slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... within each shard, in the order of ``order``.

    Ranges of (shard, order) are numbered side by side; their sizes, one row per range and
    shard, give each range its first number.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(ranges, "shard", *order).withColumn("_range_", F.spark_partition_id())
    ranged = saved(ranged, "ranged")
    counts = ranged.groupBy("shard", "_range_").count()
    before = Window.partitionBy("shard").orderBy("_range_").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_range_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first_"))
    within = Window.partitionBy("shard", "_range_").orderBy(*order)
    numbered = beside(ranged, first, ["shard", "_range_"], "inner")
    return numbered.withColumn("slot", F.row_number().over(within) - 1 + F.col("_first_")).drop("_range_", "_first_")


def shard_by_bytes(
    df: DataFrame, text: Column, shards: int = 16, doc_id: str = "doc_id", bucket: int = BUCKET
) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) per row; sizes per shard are nearly equal."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(text.isNull(), "null").otherwise(F.sha2(raw, 256)).alias("group"),
    )
    rows = saved(rows, "sizes")
    groups = rows.groupBy(F.col("group").alias("key")).agg(F.sum("size").alias("size"))
    found = assign_groups(saved(groups, "groups"), shards, bucket)
    placed = rows.join(found.withColumnRenamed("key", "group"), "group")
    return _slots(placed, ["doc_id", "group"])
