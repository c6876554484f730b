"""Embedding whitening by a one-sided Jacobi SVD of a blockwise TSQR.

Vectors become integers, so their sums are exact. Each task reduces its centred rows, block by block, to one triangular factor
of dims x dims; factors meet in a tree of tasks, and the last one has the singular values of all rows. Plane rotations
make its columns orthogonal: their lengths are the singular values, to high relative accuracy also for small ones, and the
product of the rotations has the components as columns. No covariance matrix is formed to find them. What the driver holds is
dims x dims numbers, whatever the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS = 8
SCALE = 1024.0
OFFSET = 100_000
FITS = float(2**62)  # integers below it add and multiply safely as int64
SWEEPS = 60


@dataclass
class Whitening:
    """n rows with sums ``sums``; ``axes`` has a unit component a row, ``sigma`` the singular values, ``square`` the sum of all squared ones."""

    n: int
    sums: list[int]
    axes: np.ndarray
    sigma: np.ndarray
    square: float


def _integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    values = batch.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * values), -FITS / 4, FITS / 4).astype(np.int64).reshape(-1, dims) + OFFSET


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: int64 where that has room, else Python's integers."""
    largest = max(float(np.abs(x).max(initial=0)) * n, max((abs(float(s)) for s in sums), default=0.0))
    if 2 * largest < FITS:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array([int(s) for s in sums], dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_numerators(x, n, sums) / n).astype(np.float64)


def _merged(vectors: DataFrame, local: Callable[[Iterator[pa.RecordBatch]], object], merge: Callable) -> object:
    """One state a task, merged in a tree; None where there is no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(local(batches))], pa.binary())], ["state"])

    both = lambda a, b: b if a is None else a if b is None else merge(a, b)
    states = vectors.select("_v").mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(bytes(r.state)))
    return states.treeAggregate(None, both, both, depth=3)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, singular values), largest first: rotations of disjoint pairs of columns until all are orthogonal."""
    a = np.array(r, dtype=np.float64)
    dims = a.shape[1]
    v = np.eye(dims)
    start = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
    a, v = a[:, start], v[:, start]
    size = dims + dims % 2
    ring = np.arange(size)
    eps = np.finfo(np.float64).eps
    nothing = (np.linalg.norm(a) * 1e-30) ** 2
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(size - 1):
            p, q = ring[: size // 2], ring[size // 2 :][::-1]
            there = (p < dims) & (q < dims)
            p, q = p[there], q[there]
            alpha, beta = np.einsum("ij,ij->j", a[:, p], a[:, p]), np.einsum("ij,ij->j", a[:, q], a[:, q])
            gamma = np.einsum("ij,ij->j", a[:, p], a[:, q])
            bound = np.sqrt(alpha) * np.sqrt(beta)
            off = (np.abs(gamma) > eps * bound) & (np.minimum(alpha, beta) > nothing)
            if off.any():
                worst = max(worst, float((np.abs(gamma[off]) / bound[off]).max()))
                p, q = p[off], q[off]
                zeta = (beta[off] - alpha[off]) / (2 * gamma[off])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    left, right = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst < 4 * eps * np.sqrt(max(dims, 1)):
            break
    sigma = np.linalg.norm(a, axis=0)
    order = np.argsort(-sigma, kind="stable")
    axes = v[:, order].T
    return axes / np.maximum(np.linalg.norm(axes, axis=1, keepdims=True), 1e-300), sigma[order]


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(_id, _v): rows whose vector is there and holds finite numbers only."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(v.isNotNull() & ~bad & (F.size(v) > 0)).select(F.col(id_col).alias("_id"), v.alias("_v"))


def fit(vectors: DataFrame) -> tuple[DataFrame, Whitening | None]:
    """The rows of ``usable`` that have the table's usual length, and the whitening of them (None: no such row)."""
    usual = vectors.groupBy(F.size("_v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not usual:
        return vectors, None
    dims = usual[0]["dims"]
    vectors = vectors.filter(F.size("_v") == dims)

    def sums(batches: Iterable[pa.RecordBatch]) -> tuple[int, np.ndarray]:
        n, total = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            x = _integers(batch, dims)
            safe = float(np.abs(x).max(initial=0)) * len(x) < FITS
            n, total = n + len(x), total + (x if safe else x.astype(object)).sum(axis=0).astype(object)
        return n, total

    n, total = _merged(vectors, sums, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    total = [int(s) for s in total]

    def factor(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        r = np.zeros((0, dims))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, _centred(_integers(batch, dims), n, total)]), mode="r")
        return r

    r = _merged(vectors, factor, lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r"))
    axes, sigma = jacobi(r)
    return vectors, Whitening(n, total, axes, sigma, float((sigma**2).sum()))


def _project(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.axes[:k].T * (np.sqrt(model.n) / model.sigma[:k])


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float:
    """The largest entry of the whitened rows' covariance minus the identity; blocks are centred, then their moments merged."""
    dims = len(model.sums)

    def moments(batches: Iterable[pa.RecordBatch]):
        state = None
        for batch in batches:
            w = _project(_integers(batch, dims), model, k)
            if len(w):
                mean = w.mean(axis=0)
                block = (len(w), mean, (w - mean).T @ (w - mean))
                state = block if state is None else merge(state, block)
        return state

    def merge(a, b):
        n, step = a[0] + b[0], b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    n, _, square = _merged(vectors, moments, merge)
    return float(np.abs(square / n - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries take no part, nor do vectors of another length than the
    most frequent one (ties: the longer). Null ids and repeated rows stay, each a row of its own. Components of no variance
    (within rounding) have no whitened value and are left out, so equal or single rows give no result, as an empty table does.
    Equal eigenvalues are numbered in the order the rotations leave them. A deviation beyond a long is null; entries are held
    within +-2**60. Other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    schema = T.StructType([T.StructField("vec_id", df.schema[id_col].dataType)] + T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields)
    vectors, model = fit(usable(df, id_col, vector_col))
    if model is None:
        return spark.createDataFrame([], schema)
    dims = len(model.sums)
    noise = model.sigma[:1].max(initial=0.0) * max(dims, 10) * 10 * np.finfo(np.float64).eps
    k = int(min(components, (model.sigma > noise).sum()))
    if k == 0:
        return spark.createDataFrame([], schema)
    error = identity_error(vectors, model, k)
    explained = model.sigma[:k] ** 2 / model.square

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch, dims)
            off = _numerators(x, model.n, model.sums)
            if off.dtype == object or float((off.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) >= FITS:
                far = [sum(int(y) ** 2 for y in row) for row in off]
                deviation = pa.array([d if d < 2**63 else None for d in far], pa.int64())
            else:
                deviation = pa.array((off**2).sum(axis=1))
            at = np.repeat(np.arange(len(x)), k)
            m = len(at)
            columns = [
                batch.column("_id").take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(m, model.n, dtype=np.int64)),
                deviation.take(pa.array(at)),
                pa.array(_project(x, model, k).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return vectors.mapInArrow(rows, schema)
