"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson.

The covariance is never formed.  A product with it is one Spark job: every task centres its
vectors and multiplies them twice, and only a sum of the size of the product comes back.  The
search space, the projected matrix and the inner MINRES recurrences are a few vectors of one
embedding's length on the driver; MINRES runs for all wanted vectors in step, so that each of
its steps is one job for all.  Converged vectors are locked, the first in order first, until
every residual is below ``RESIDUAL`` times the largest eigenvalue.

Whole numbers x = floor(scale * c) + offset are centred exactly: x - S / n is taken as a whole
difference and a remainder below one.

Results: null vectors, and those with null, NaN or infinite entries, take no part, nor do
vectors of another length than the most frequent one (of equally frequent ones the longest) or
empty ones.  Repeated rows, and rows without id, count and are returned as often as they
stand there.  Components without variance (below ``LEAST`` of the largest eigenvalue) have no
whitened value and are left out, so fewer than ``count`` may come, and equal vectors give none.
An empty table gives no rows.  An entry of 2 ** 52 or more after scaling is an error.  Of each
component the entry of the largest size is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.store import saved

BLOCK_BYTES = 128 * 1024
RESIDUAL = 1e-13
LEAST = 1e-10
GUARD, MAX_SPACE, INNER_STEPS, OUTER_STEPS, SEED = 4, 48, 12, 200, 42
_PACKED = "ids array<long>, x binary"


class Fit(NamedTuple):
    """What a fit gives: number of vectors, sums, eigenvalues, vectors (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``block`` outside ``against``; dependent ones go."""
    found = against
    for column in block.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - found @ (found.T @ column)
        if size and np.linalg.norm(column) > 1e-12 * size:
            column = column / np.linalg.norm(column)
            column = column - found @ (found.T @ column)
            found = np.column_stack([found, column / np.linalg.norm(column)])
    return found[:, against.shape[1] :]


def minres(product: Callable, shifts: np.ndarray, right: np.ndarray, outside: np.ndarray, steps: int, least: float):
    """Solve (A - shift) t = right for each column in the space orthogonal to ``outside``.

    All columns advance in step, so each step is one product; it ends after ``steps`` or when
    every residual is below ``least`` of its right side.
    """

    def project(block: np.ndarray) -> np.ndarray:
        block = block - outside @ (outside.T @ block)
        return block - outside @ (outside.T @ block)

    right = project(right)
    beta = np.linalg.norm(right, axis=0)
    start = np.where(beta > 0, beta, 1)
    before, now = np.zeros_like(right), right / start
    solution, step_old, step = (np.zeros_like(right) for _ in range(3))
    rest, beta = start.copy(), np.zeros(len(start))
    cos_old, sin_old, cos, sin = np.ones_like(start), np.zeros_like(start), np.ones_like(start), np.zeros_like(start)
    live = np.linalg.norm(right, axis=0) > 0
    for _ in range(steps):
        image = project(product(now) - now * shifts)
        alpha = (now * image).sum(axis=0)
        following = project(image - now * alpha - before * beta)
        beta_next = np.linalg.norm(following, axis=0)
        # The new column of the tridiagonal matrix, turned by the two rotations before it.
        first, second = sin_old * beta, cos_old * beta
        second, third = cos * second + sin * alpha, -sin * second + cos * alpha
        length = np.hypot(third, beta_next)
        live &= length > 0
        safe = np.where(length > 0, length, 1)
        cos_old, sin_old = cos, sin
        cos, sin = third / safe, beta_next / safe
        step_old, step = step, (now - step * second - step_old * first) / safe
        solution = np.where(live, solution + step * (rest * cos), solution)
        rest = np.where(live, -rest * sin, rest)
        live &= (np.abs(rest) > least * start) & (beta_next > 1e-14 * start)
        if not live.any():
            break
        before, now = now, following / np.where(beta_next > 0, beta_next, 1)
        beta = beta_next
    return project(solution)


def eigenpairs(product: Callable, dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their vectors, of a symmetric operator.

    ``product`` maps a (dim, any) block to its image; eigenvalues are not negative.
    """
    count = min(count, dim)
    width = min(dim, count + GUARD)
    space = orthonormal(np.random.default_rng(SEED).standard_normal((dim, width)), np.zeros((dim, 0)))
    image = product(space)
    # Two steps of a block Krylov space give the first Ritz values their order.
    for _ in range(2):
        if (more := orthonormal(image[:, -width:], space)).shape[1]:
            space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])
    locked, values = np.zeros((dim, 0)), []
    for outer in range(OUTER_STEPS):
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        most = max([*values, ritz[0], 0])
        missing = image - space * ritz
        if locked.shape[1]:
            missing -= locked @ (locked.T @ missing)
        apart = np.linalg.norm(missing, axis=0)
        done = 0
        while done < count - len(values) and apart[done] <= RESIDUAL * most:
            done += 1
        if done:
            locked, values = np.column_stack([locked, space[:, :done]]), [*values, *ritz[:done]]
            space, image, ritz, missing, apart = space[:, done:], image[:, done:], ritz[done:], missing[:, done:], apart[done:]
        if len(values) == count:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        if space.shape[1] > MAX_SPACE:
            space, image = space[:, : 2 * width], image[:, : 2 * width]
            ritz, missing, apart = ritz[: 2 * width], missing[:, : 2 * width], apart[: 2 * width]
        open_ = [i for i in range(min(count - len(values), space.shape[1])) if apart[i] > RESIDUAL * most]
        outside = np.column_stack([locked, space[:, : count - len(values)]])
        new = minres(product, ritz[open_], -missing[:, open_], outside, INNER_STEPS, max(1e-4, 0.3 * 0.5**outer))
        held = np.column_stack([locked, space])
        new = orthonormal(np.column_stack([new, missing[:, open_]]), held)[:, : dim - held.shape[1]]
        if not new.shape[1]:
            raise RuntimeError("the search space cannot grow, and a residual is too large")
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    raise RuntimeError("the eigenvectors did not settle")


def whole_vectors(df: DataFrame, vec_id: Column, vector: Column, scale: int, offset: int) -> DataFrame:
    """(id, x) for the vectors that take part, of any length."""
    rows = df.select(vec_id.alias("id"), vector.cast("array<double>").alias("v")).where("v is not null")
    bad = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)) | c.isNull()
    rows = rows.where(~F.exists("v", bad) & (F.size("v") > 0))

    def whole(c: Column) -> Column:
        scaled = c * F.lit(float(scale))
        beyond = F.raise_error(F.lit("an entry is too large for whole numbers")).cast("long")
        return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled) + F.lit(offset)).otherwise(beyond)

    return rows.select("id", F.transform("v", whole).alias("x"))


def _pack(dim: int):
    """Vectors as blocks: ids, and the entries row by row as 64-bit numbers."""
    most = max(1, BLOCK_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(batch), dim)
            for at in range(0, len(batch), most):
                own = flat[at : at + most]
                ids = pa.array([batch.column("id")[at : at + most].to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([own.tobytes()], pa.binary())], ["ids", "x"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, raw in zip(batch.column("ids"), batch.column("x")):
            yield ids.values, np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim)


def _summed(packed: DataFrame, dim: int, shape: tuple[int, ...], part: Callable, kind: type) -> np.ndarray:
    """Sum of ``part(x)`` over all blocks: a partial sum per task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_yet = np.zeros(shape, kind), False
        for _, own in _blocks(batches, dim):
            total, any_yet = total + part(own), True
        if any_yet:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["part"])

    name = "double" if kind is float else "long"
    parts = packed.select("ids", "x").mapInArrow(run, f"part array<{name}>").select(F.posexplode("part"))
    total = np.zeros(int(np.prod(shape)), kind)
    for pos, value in parts.groupBy("pos").agg(F.sum("col")).collect():
        total[pos] = value
    return total.reshape(shape)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each dimension as a whole number and a remainder over n."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(near, np.int64), np.array([s - n * r for s, r in zip(sums, near)], np.int64)


def centred(own: np.ndarray, n: int, near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (own - near).astype(float) - rest / n


def deviations(own: np.ndarray, n: int, near: np.ndarray, rest: np.ndarray) -> list[int]:
    """Per vector the sum over dimensions of (n * x - S) ** 2, exact."""
    whole = own - near
    most = n * int(np.abs(whole).max(initial=0)) + int(np.abs(rest).max(initial=0))
    if most * most * own.shape[1] >= 2**63:
        whole, rest = whole.astype(object), rest.astype(object)
    return ((n * whole - rest) ** 2).sum(axis=1).tolist()


def pack(df: DataFrame, vec_id: Column, vector: Column, scale: int, offset: int) -> tuple[DataFrame, int]:
    """The vectors that take part, as a stored table of blocks, and their length (0: there are none)."""
    rows = whole_vectors(df, vec_id, vector, scale, offset)
    size = F.size("x").alias("dim")
    first = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = first.dim if first else 0
    blocks = rows.where(F.size("x") == dim).mapInArrow(_pack(max(dim, 1)), _PACKED)
    return saved(blocks, "vectors"), dim


def fit(packed: DataFrame, dim: int, count: int) -> Fit:
    """Leading eigenpairs of the covariance (divisor n) of packed vectors, ``count`` at most."""
    n = int(packed.agg(F.sum(F.size("ids"))).first()[0])
    sums = [int(s) for s in _summed(packed, dim, (dim,), lambda own: own.sum(axis=0), np.int64)]
    near, rest = _centre(n, sums)

    def product(block: np.ndarray) -> np.ndarray:
        def part(own: np.ndarray) -> np.ndarray:
            apart = centred(own, n, near, rest)
            return apart.T @ (apart @ block)

        return _summed(packed, dim, block.shape, part, float) / n

    def square(own: np.ndarray) -> np.ndarray:
        return (centred(own, n, near, rest) ** 2).sum(axis=0)

    variances = _summed(packed, dim, (dim,), square, float) / n
    trace = float(variances.sum())
    if trace == 0:
        return Fit(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    values, vectors = eigenpairs(product, dim, count)
    kept = values > LEAST * values[0]
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Fit(n, sums, values, vectors, trace)


def _whitened(own: np.ndarray, fitted: Fit, near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return centred(own, fitted.n, near, rest) @ fitted.vectors / np.sqrt(fitted.values)


def identity_error(packed: DataFrame, dim: int, fitted: Fit) -> float:
    """Largest entry by size of the covariance of the whitened values less the identity."""
    near, rest = _centre(fitted.n, fitted.sums)
    count = len(fitted.values)

    def part(own: np.ndarray) -> np.ndarray:
        out = _whitened(own, fitted, near, rest)
        return np.vstack([out.T @ out, out.sum(axis=0)])

    total = _summed(packed, dim, (count + 1, count), part, float) / fitted.n
    covariance = total[:-1] - np.outer(total[-1], total[-1])
    return float(np.abs(covariance - np.eye(count)).max(initial=0))


def transform(packed: DataFrame, dim: int, fitted: Fit) -> DataFrame:
    """(id, deviation, whitened): whitened values of each vector, by component."""
    near, rest = _centre(fitted.n, fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in _blocks(batches, dim):
            out = _whitened(own, fitted, near, rest)
            apart = pa.array([str(d) for d in deviations(own, fitted.n, near, rest)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, apart, pa.array(list(out), pa.list_(pa.float64()))], ["id", "deviation", "whitened"]
            )

    found = packed.mapInArrow(run, "id long, deviation string, whitened array<double>")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(
    df: DataFrame, count: int = 8, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, offset: int = 100_000
) -> DataFrame:
    """One row per vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    packed, dim = pack(df, F.col(vec_id), F.col(vector), scale, offset)
    nothing = Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    fitted = fit(packed, dim, count) if dim else nothing
    error = identity_error(packed, dim, fitted) if len(fitted.values) else 0.0
    rows = transform(packed, max(dim, 1), fitted).select("id", "deviation", F.posexplode("whitened"))
    shares = F.lit([float(v / fitted.trace) for v in fitted.values]) if len(fitted.values) else F.lit(None).cast("array<double>")
    return rows.select(
        F.col("id").alias("vec_id"),
        (F.col("pos") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.col("col").alias("whitened"),
        F.get(shares, F.col("pos")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
