import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import topk


def brute(rows, k, is_query):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(256 * x) for x in v]
    out = []
    for q, a in good.items():
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(a) == len(b))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (6, 8))
    points = np.rint(centres[rng.integers(0, 6, 1500)] + rng.normal(0, 9 if seed % 2 else 60, (1500, 8)))
    points[100:200] = points[99]
    queries = points[rng.integers(0, 1500, 150)]
    ids = rng.permutation(1500)
    scores, found = topk.search(queries, np.full(150, topk._NONE), points, ids, 6)
    for q, s, f in zip(queries, scores, found):
        want = sorted(zip((-(points @ q)).astype(int).tolist(), ids.tolist()))[:6]
        assert [(-a, b) for a, b in want] == list(zip(s.tolist(), f.tolist()))


def rows(seed, n):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(n)]
    out += [(n + i, out[3][1]) for i in range(40)]  # many equal vectors
    out += [(900, None), (910, [0.1] * 5 + [None]), (920, [math.nan] * 6), (930, [math.inf] + [0.0] * 5), (None, [0.1] * 6)]
    out += [(940, [0.5, 0.5]), (950, [0.25, -1.0]), (960, []), (970, [0.0] * 6), out[0], out[10]]
    return out


def test_operator(spark):
    data = rows(2, 300)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, id int, score int")
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    want = brute(data, 5, lambda q: q % 10 == 0)
    for sizes in ({}, {"block_rows": 7, "query_rows": 5}):
        got = topk.top_k(df, 5, F.col("vec_id") % 10 == 0, **sizes).collect()
        assert sorted(tuple(r) for r in got) == want
    few = df.where("vec_id in (0, 10, 20)")
    assert topk.top_k(few, 5, F.col("vec_id") % 10 == 0).count() == 6
    assert topk.top_k(df.limit(0), 5, F.col("vec_id") % 10 == 0).count() == 0


def test_large_components(spark):
    """Whole numbers beyond 32 bits, products beyond what doubles hold, and what is no lawful score."""
    data = [(0, [1e7, 1.0]), (10, [3e12, -2.0]), (1, [40.0, 1e12]), (2, [1e7, 0.0]), (3, [-3e12, 5.5]), (4, [0.25, 7e4])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id <> 10"), 3, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute([r for r in data if r[0] != 10], 3, lambda q: q % 10 == 0)
    with pytest.raises(Exception, match="outside the range of long"):
        topk.top_k(df, 3, F.col("vec_id") % 10 == 0).collect()
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e15]), (1, [1.0])], df.schema), 3, F.col("vec_id") == 0).collect()
    wide = np.array([[2.0**52, 3.0]])
    assert topk._products(wide, np.array([[1.0, 2.0**50 + 1], [2.0**10, 0.0]])).tolist() == [[2**52 + 3 * (2**50 + 1), 2**62]]
