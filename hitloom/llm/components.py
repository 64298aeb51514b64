"""Connected components of a large graph by alternating star contractions.

Every round points the larger neighbours of a node, then the smaller ones, at its least
neighbour; the number of rounds grows with the logarithm of the longest path.  Minima are
pre-aggregated and joined back, so a node with very many links does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.store import dropped, saved

MAX_ROUNDS = 60


def _least(links: DataFrame) -> DataFrame:
    """Each node ``u`` with its least neighbour, itself included."""
    return links.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pointed = both.join(_least(both), "u")
    return pointed.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u > v")
    least = _least(down)
    pointed = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return pointed.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (u, v) but the roots; a root is its component's least node."""
    spark = edges.sparkSession
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = saved(links.distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(row) == mark or not row[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, before = tuple(row), now
        now = saved(_small_star(_large_star(now)), "links")
        dropped(spark, before)
    raise RuntimeError("the components did not settle")
