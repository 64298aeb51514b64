"""Exact top-k by inner product: dual-tree search over cover trees.

The first level of the index is a bounded number of pivots, picked farthest-first from a
sample of ``SAMPLE_ROWS`` vectors; every vector joins the cell of its nearest pivot, and a
cell is cut into blocks of about ``block_rows``.  In a task a block and its queries each get
a cover tree; node pairs are visited best first and pruned when the bound from centres and
covering radii is below the worst kth score in the query node.  Before that, each query is
searched in one block of the cell with the best pivot, and the kth score found there prunes
whole cells.

Results: vectors that are null or hold null, NaN or infinite components take no part, nor do
rows without id; a row that is repeated counts once; a row of the query's own id is never its
candidate; ties go to the smaller id; vectors of another length are no candidates; a query
with fewer candidates than k returns them all.  Equal vectors meet before the search: of them
only the k + 1 smallest ids are indexed, which is exact, and equal queries are searched once.
A score outside the range of long is an error, as is a component of 2 ** 45 or more, whose
whole number no double holds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitloom.llm.store import beside, saved

SAMPLE_ROWS = 4096
PIVOTS = 64
BLOCK_ROWS = 50_000
QUERY_ROWS = 50_000
LEAF_QUERIES, LEAF_ROWS, FAN_OUT = 64, 128, 16
_NONE = -np.iinfo(np.int64).max


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Rows of up to ``count`` points far from each other, the one nearest the mean first."""
    first = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    chosen, far = [first], ((points - points[first]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


class CoverTree:
    """Nodes (centre, covering radius, rows, children) in arrays; the root is node 0."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points
        self.centre, self.radius, self.rows, self.children = [], [], [], []
        stack = [(np.arange(len(points)), None)]
        while stack:
            rows, parent = stack.pop()
            own = points[rows]
            centre = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()]
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            node = len(self.rows)
            self.centre.append(centre)
            self.radius.append(float(away.max()))
            self.rows.append(rows)
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if len(rows) > leaf and away.max() > 0:
                pivots = own[farthest_first(own, FAN_OUT)]
                near = ((pivots**2).sum(axis=1) - 2 * own @ pivots.T).argmin(axis=1)
                if (near == near[0]).all():
                    near = np.arange(len(rows)) % 2
                stack += [(rows[near == c], node) for c in np.unique(near)]
        self.norm = [float(np.sqrt((c**2).sum())) for c in self.centre]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    if max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("a score is outside the range of long")
    return exact.astype(np.int64)


def search(queries: np.ndarray, least: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
    """(scores, ids), each of shape (queries, k), best first; empty places hold ``_NONE``.

    ``least``: a score per query below which nothing is wanted.
    """
    scores = np.full((len(queries), k), _NONE, np.int64)
    found = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
    if not len(queries) or not len(points):
        return scores, found
    q, r = CoverTree(queries, LEAF_QUERIES), CoverTree(points, LEAF_ROWS)

    def bound(a: int, b: int) -> float:
        value = float(q.centre[a] @ r.centre[b]) + q.radius[a] * (r.norm[b] + r.radius[b]) + r.radius[b] * q.norm[a]
        return value + 1e-9 * (abs(value) + 1)

    def worst(a: int) -> int:
        rows = q.rows[a]
        return int(np.maximum(scores[rows, -1], least[rows]).min())

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        high, a, b = heapq.heappop(heap)
        if -high < worst(a):
            continue
        if not q.children[a] and not r.children[b]:
            rows, others = q.rows[a], r.rows[b]
            new = _products(queries[rows], points[others])
            better = (new.max(axis=1) >= np.maximum(scores[rows, -1], least[rows])).nonzero()[0]
            if len(better):
                at = rows[better]
                all_scores = np.hstack([scores[at], new[better]])
                all_ids = np.hstack([found[at], np.broadcast_to(ids[others], (len(at), len(others)))])
                order = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
                scores[at] = np.take_along_axis(all_scores, order, 1)
                found[at] = np.take_along_axis(all_ids, order, 1)
            continue
        # The node with the larger radius is opened.
        open_query = bool(q.children[a]) and (not r.children[b] or q.radius[a] >= r.radius[b])
        for a2, b2 in [(c, b) for c in q.children[a]] if open_query else [(a, c) for c in r.children[b]]:
            if (value := bound(a2, b2)) >= worst(a2):
                heapq.heappush(heap, (-value, a2, b2))
    return scores, found


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(column), dim)


def whole_numbers(df: DataFrame, vec_id: Column, vector: Column) -> DataFrame:
    """(id, v): floor(256 * x) of the components, for the vectors that take part."""
    rows = df.select(vec_id.alias("id"), vector.cast("array<double>").alias("x")).where("id is not null and x is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("x", lambda x: F.coalesce(bad(x), F.lit(True))))

    def whole(x: Column) -> Column:
        beyond = F.raise_error(F.lit("a component is too large for whole numbers")).cast("long")
        return F.when(F.abs(x) < 2.0**45, F.floor(x * 256)).otherwise(beyond)

    return rows.select("id", F.transform("x", whole).alias("v"))


def _cells(pivots: dict[int, np.ndarray], by_score: bool):
    """Adds the cell of each vector: its nearest pivot, or the one with the best score."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            cell, away = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points, own = _matrix(pa.chunked_array([lists.take(pa.array(at))]), dim), pivots[int(dim)]
                score = points @ own.T
                apart = (points**2).sum(axis=1)[:, None] - 2 * score + (own**2).sum(axis=1)
                best = score.argmax(axis=1) if by_score else apart.argmin(axis=1)
                cell[at] = best
                away[at] = np.sqrt(np.maximum(apart[np.arange(len(at)), best], 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(dims.astype(np.int32)), pa.array(cell), pa.array(away)],
                [*batch.schema.names, "dim", "cell", "away"],
            )

    return run


_FOUND = "q long, id long, score long"


def _search_blocks(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("q", "id", "score")})
        if not len(rows) or not len(queries):
            return empty
        dim = len(rows["v"][0])
        least = queries["least"].to_numpy()
        ids = rows["id"].to_numpy()
        scores, found = search(_matrix(queries["v"], dim), least, _matrix(rows["v"], dim), ids, k)
        at, place = np.nonzero((scores > _NONE) & (scores >= least[:, None]))
        q = queries["q"].to_numpy()[at]
        return pa.table({"q": q, "id": found[at, place], "score": scores[at, place]})

    return run


def _searched(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    keys = ["dim", "cell", "sub", "part"]
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_search_blocks(k), _FOUND)


def top_k(
    df: DataFrame,
    k: int,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query."""
    spark = df.sparkSession
    chosen = F.coalesce(is_query, F.lit(False))
    rows = whole_numbers(df, F.col(vec_id), F.col(vector)).dropDuplicates(["id", "v"])
    rows = saved(rows, "vectors")
    equal = Window.partitionBy("v").orderBy("id")
    points = rows.withColumn("n", F.dense_rank().over(equal)).where(F.col("n") <= k + 1).drop("n")
    asked = whole_numbers(df.where(chosen), F.col(vec_id), F.col(vector)).dropDuplicates()
    asked = saved(asked, "asked")
    queries = saved(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")

    sample = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(len(row.v), []).append(row.v)
    for row in rows.groupBy(F.size("v").alias("dim")).agg(F.min("v").alias("v")).collect():
        by_dim.setdefault(row.dim, []).append(row.v)
    pivots = {}
    for dim, vectors in by_dim.items():
        near = np.array(vectors, float).reshape(len(vectors), dim)
        pivots[dim] = near[farthest_first(near, PIVOTS)]

    kept = "id long, v array<long>, dim int, cell int, away double"
    points = saved(points.mapInArrow(_cells(pivots, False), kept), "points")
    cells = points.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    subs = {(c.dim, c.cell): -(-c.n // block_rows) for c in cells}
    parts = -(-max(1, queries.count()) // query_rows)

    blocks = spark.createDataFrame([(d, c, n) for (d, c), n in subs.items()] or [(0, 0, 1)], "dim int, cell int, subs int")
    part = F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part")
    dealt = beside(points, blocks, ["dim", "cell"], "inner").select(
        "id", "v", "dim", "cell", F.pmod(F.xxhash64("id", "v"), "subs").cast("int").alias("sub")
    )
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    home = queries.select("q", "v").mapInArrow(_cells(pivots, True), kept.replace("id long", "q long"))
    nothing = F.lit(int(_NONE))
    seeds = home.select("q", "v", "dim", "cell", F.lit(0).alias("sub"), part, nothing.alias("least"))
    first = _searched(dealt.where("sub = 0"), seeds, k + 1)
    kth = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") > k)
    started = queries.join(saved(kth, "kth"), "q", "left").select("q", "v", F.coalesce("s", nothing).alias("least"))

    radius = {(c.dim, c.cell): c.radius for c in cells}
    asked_cells = started.mapInArrow(_open_cells(pivots, radius), "q long, v array<long>, least long, dim int, cell int")
    wide = beside(asked_cells, blocks, ["dim", "cell"], "inner")
    wide = wide.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    found = _searched(dealt, wide.select("q", "v", "dim", "cell", "sub", part, "least"), k + 1)

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = saved(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "found")
    named = asked.select(F.col("id").alias("query_id"), "v").join(queries, "v").select("query_id", "q")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id"))
    answers = named.join(found, "q").where(F.col("id") != F.col("query_id")).withColumn("rank", rank)
    return answers.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _open_cells(pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float]):
    """Each query once per cell that can hold a score as good as its least one."""

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                v = batch.column("v")[row].values.to_numpy(zero_copy_only=False).astype(float)
                own, dim = pivots[len(v)], len(v)
                high = own @ v + np.sqrt((v**2).sum()) * np.array([radius.get((dim, c), -np.inf) for c in range(len(own))])
                least = batch.column("least")[row].as_py()
                cells = np.flatnonzero(high + 1e-9 * (np.abs(high) + 1) >= least) if dim else np.array([0])
                take = pa.array(np.full(len(cells), row))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(take) for c in ("q", "v", "least")),
                        pa.array(np.full(len(cells), dim, np.int32)),
                        pa.array(cells.astype(np.int32)),
                    ],
                    ["q", "v", "least", "dim", "cell"],
                )

    return run
