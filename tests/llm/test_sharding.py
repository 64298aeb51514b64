import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import sharding


@pytest.mark.parametrize("shards", [1, 2, 3, 16])
def test_differencing(shards):
    rng = random.Random(shards)
    for n in (1, 2, 5, 300):
        sizes = [rng.choice([1, 1, 7, rng.randrange(1, 5000)]) for _ in range(n)]
        loads = np.zeros((n, shards), np.int64)
        loads[:, 0] = sizes
        total, became = sharding.difference(loads)
        assert all(sorted(row) == list(range(shards)) for row in became.tolist())
        real = [0] * shards
        for size, shard in zip(sizes, became[:, 0]):
            real[shard] += size
        assert real == total.tolist()
        if n == 300:
            assert max(real) - min(real) <= 0.02 * sum(real) / shards + 8


def test_known_differencing():
    """8, 7, 6, 5, 4 on two shards: the differences leave 2 (16 and 14)."""
    loads = np.array([[x, 0] for x in (8, 7, 6, 5, 4)])
    assert sorted(sharding.difference(loads)[0].tolist()) == [14, 16]


def check(rows, texts, shards):
    assert sorted((r.doc_id or -1) for r in rows) == sorted((i or -1) for i, _ in texts)
    slots, loads, groups = defaultdict(list), [0] * shards, defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        groups[r.group].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    return loads


def test_operator(spark):
    rng = random.Random(4)
    texts = [(i, "é" * rng.randrange(0, 400) + str(rng.randrange(400))) for i in range(1500)]
    texts += [(5000 + i, "copy") for i in range(300)] + [(1, None), (None, "x"), (7, ""), (7, ""), (None, None)]
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, size int, shard int")
    for bucket in (sharding.BUCKET, 9):  # one level, then several
        rows = sharding.shard_by_bytes(df, F.col("text"), 8, bucket=bucket).collect()
        loads = check(rows, texts, 8)
        assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    sizes = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts[:1500]}
    assert all((r.size, r.text_crc32) == sizes[r.doc_id] for r in rows if r.doc_id in sizes and r.doc_id not in (1, 7))
    assert sharding.shard_by_bytes(df.limit(0), F.col("text"), 8).count() == 0
    one = sharding.shard_by_bytes(df.where("text = 'copy'"), F.col("text"), 8).collect()
    assert len({r.shard for r in one}) == 1
