import numpy as np
import pytest

from hitloom.llm import whitening as w

NAN, INF = float("nan"), float("inf")


def plain(vectors, count=8):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n, sums = len(x), x.sum(axis=0)
    apart = x - sums / n
    values, turn = np.linalg.eigh(apart.T @ apart / n)
    values, turn = values[::-1][:count], turn[:, ::-1][:, :count]
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, exact, values, turn, apart @ turn / np.sqrt(values), (apart**2).sum() / n


def test_against_a_dense_solver(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.standard_normal((700, 40)) @ rng.standard_normal((40, 40)) * 0.05).tolist()
    rows = [(i, v, 1, "e") for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [None] + vectors[0][1:]), (902, [NAN] + vectors[0][1:]), (903, [-INF] + vectors[0][1:]), (904, []), (905, [1.0])]
    repeated = [(0, vectors[0]), (None, vectors[1])]
    rows += [(*r, 2, "e") for r in odd + repeated]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, explained string").repartition(7)
    found = w.whiten(df).collect()
    n, exact, values, turn, want, trace = plain(vectors + [vectors[0], vectors[1]])
    assert len(found) == 8 * n == 8 * 702
    own = {}
    for r in found:
        own.setdefault((r.vec_id, r.component), []).append(r)
    signs = [np.sign(own[5, c + 1][0].whitened / want[5, c]) for c in range(8)]
    for i in range(700):
        for c in range(8):
            same = own[i, c + 1]
            assert len(same) == (2 if i == 0 else 1)
            r = same[0]
            assert r.n == n and int(r.deviation) == exact[i]
            assert abs(signs[c] * r.whitened - want[i, c]) < 1e-9
            assert abs(r.explained - values[c] / trace) < 1e-12 and r.identity_error < 1e-9
    assert len(own[None, 1]) == 1


@pytest.mark.parametrize("dim, n", [(1, 9), (5, 100), (9, 50), (64, 6), (120, 400), (200, 150)])
def test_eigenpairs(dim, n):
    rng = np.random.default_rng(dim)
    apart = rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim))
    apart -= apart.mean(axis=0)
    jobs = []

    def product(block):
        jobs.append(1)
        return apart.T @ (apart @ block) / n

    values, vectors = w.eigenpairs(product, dim, 8)
    want = np.linalg.eigvalsh(apart.T @ apart / n)[::-1][: min(8, dim)]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(product(vectors) - vectors * values).max() <= 2 * w.RESIDUAL * want[0]
    assert len(jobs) < 150


def test_equal_eigenvalues():
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.standard_normal((100, 100)))[0]
    for own in (np.ones(100), np.r_[np.full(5, 3.0), np.full(5, 2.0), np.ones(90)], np.r_[1e6, np.linspace(2, 1, 99)]):
        values, vectors = w.eigenpairs(lambda block: turn @ (own[:, None] * (turn.T @ block)), 100, 8)
        assert np.abs(values - np.sort(own)[::-1][:8]).max() < 1e-12 * own.max()
        assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12


def test_minres_solves_in_the_complement():
    rng = np.random.default_rng(2)
    half = rng.standard_normal((30, 30))
    matrix = half + half.T
    outside = np.linalg.qr(rng.standard_normal((30, 3)))[0]
    right = rng.standard_normal((30, 2))
    found = w.minres(lambda b: matrix @ b, np.array([0.3, -0.2]), right, outside, 60, 1e-13)
    project = np.eye(30) - outside @ outside.T
    for j, shift in enumerate((0.3, -0.2)):
        left = project @ ((matrix - shift * np.eye(30)) @ found[:, j])
        assert np.abs(left - project @ right[:, j]).max() < 1e-8 and np.abs(outside.T @ found[:, j]).max() < 1e-10


def test_no_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert w.whiten(spark.createDataFrame([], schema)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, [0.5, 2.0])] * 3, schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 0.25, 1.0 - i]) for i in range(6)], schema)
    rows = w.whiten(line).collect()  # one component has variance
    assert len(rows) == 6 and {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12
    assert abs(sum(r.whitened**2 for r in rows) / 6 - 1) < 1e-9


def test_large_entries(spark):
    schema = "vec_id long, embedding array<double>"
    own = [[1e9, 0.5], [-3e9, 1.0], [2e9, 7.0]]
    found = w.whiten(spark.createDataFrame(list(enumerate(own)), schema), 1).collect()
    _, exact, *_ = plain(own, 1)
    assert [int(r.deviation) for r in sorted(found, key=lambda r: r.vec_id)] == exact
    with pytest.raises(Exception, match="too large"):
        w.whiten(spark.createDataFrame([(1, [1e30])], schema)).collect()


def test_most_frequent_length(spark):
    rows = [(1, [1.0]), (2, [2.0, 1.0]), (3, [0.0, 3.0]), (4, [4.0])]
    found = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id for r in found.collect()} == {2, 3}
