"""Whitening beside numpy's own decomposition of the covariance, and the cases of the docstring."""

import numpy as np
import pytest

from factloom.llm.whitening import _integers, fit, jacobi, usable, whiten  # noqa: F401


def _brute(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n = len(x)
    off = n * x - x.sum(axis=0)
    c = off / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, (off**2).sum(axis=1), c, e[::-1], u[:, ::-1]


def _table(spark, rows, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


def test_beside_numpy(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.geomspace(3, 0.02, 12)[:, None]
    vectors = (rng.normal(size=(300, 12)) @ mix + 5).astype(np.float32)
    df = _table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]).repartition(5)
    got = whiten(df).toPandas().sort_values(["vec_id", "component"])
    n, deviation, c, e, u = _brute(vectors.astype(float))
    assert len(got) == 300 * 8 and (got.n == n).all()
    assert (got.deviation.to_numpy()[::8] == deviation).all()
    explained = got.explained.to_numpy()[:8]
    assert np.abs(explained / (e[:8] / e.sum()) - 1).max() < 1e-9
    w = got.whitened.to_numpy().reshape(300, 8)
    assert np.abs(np.abs(w) - np.abs(c @ u[:, :8] / np.sqrt(e[:8]))).max() < 1e-8
    assert got.identity_error.nunique() == 1
    error = np.abs(np.cov(w.T, bias=True) - np.eye(8)).max()
    assert got.identity_error.iloc[0] < 1e-9 and error < 1e-9


def test_small_values_stay_accurate():
    """A graded triangle: one-sided rotations find the smallest value to many digits, where squares of it would be lost."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    want = 10.0 ** -np.arange(0, 12, 2)
    axes, sigma = jacobi(q * want)
    assert np.abs(sigma / want - 1).max() < 1e-10
    assert np.abs(axes @ axes.T - np.eye(6)).max() < 1e-13


@pytest.mark.parametrize("shape", [(1, 1), (3, 1), (2, 5), (7, 7)])
def test_shapes_of_triangles(shape):
    a = np.random.default_rng(0).normal(size=shape)
    axes, sigma = jacobi(a)
    assert np.allclose(sigma[: min(shape)], np.linalg.svd(a, compute_uv=False)) and np.allclose(sigma[min(shape) :], 0)
    assert np.allclose(axes.T @ np.diag(sigma**2) @ axes, a.T @ a)


def test_cases(spark):
    rows = [(i, [float(i % 7), float(i % 3), float(i * i % 5)], 1) for i in range(40)]
    odd = [(None, [1.0, 2.0, 0.0], 1), (90, None, 1), (91, [1.0, None, 2.0], 1), (92, [float("nan"), 1.0, 1.0], 1), (93, [float("inf"), 1.0, 1.0], 1), (94, [], 1), (95, [1.0, 2.0], 1), (3, [3.0, 0.0, 4.0], 1), (3, [3.0, 0.0, 4.0], 1)]
    df = _table(spark, rows + odd, "vec_id long, embedding array<float>, component int")
    got = whiten(df).toPandas()
    assert set(got.component) == {1, 2, 3} and (got.n == 43).all()
    assert got.vec_id.isna().sum() == 3 and (got.vec_id == 3).sum() == 9
    assert not set(got.vec_id.dropna()) & {90, 91, 92, 93, 94, 95}
    double = whiten(_table(spark, [r[:2] for r in rows], "vec_id long, embedding array<double>"))
    assert double.count() == 120


def test_no_variance_and_no_rows(spark):
    assert whiten(_table(spark, [])).count() == 0
    assert whiten(_table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(_table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    flat = whiten(_table(spark, [(i, [float(i), 2.0]) for i in range(5)])).toPandas()
    assert set(flat.component) == {1} and np.allclose(flat.explained, 1)


def test_large_entries(spark):
    """Sums beyond a long are exact; a deviation beyond a long is null."""
    got = whiten(_table(spark, [(i, [float(i) * 1e12, 1.0]) for i in range(6)])).toPandas()
    assert got.deviation.isna().all() and got.identity_error.max() < 1e-9
