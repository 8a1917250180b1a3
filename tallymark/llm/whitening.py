"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Spark counts and centres: the distinct vectors are the fit list, each task folds
its part of them into one covariance, and the parts are merged by groups of 32.
Only what has the size of the vector's dimension, never of the data, meets on the
driver: the sums and the covariance V. There V = L L' is factored with pivoting,
and the columns of L are rotated in pairs until they are orthogonal. Then
L W = U diag(sigma), so the squared column norms are the eigenvalues of V and the
normalised columns its eigenvectors; V itself is never rotated or squared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize

SCALE = 256
COMPONENTS = 4
FAN_IN = 32
SWEEPS = 64
_EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """The fitted components: ``values`` fall, ``vectors`` has one column for each, ``sums`` are exact."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # int / int rounds correctly, whatever the size

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', as many columns as ``a`` has rank; the largest remaining diagonal entry is eliminated next.

    The rows stay in the order of ``a``: sorted by the step in which they were the pivot, L is lower triangular.
    """
    d = len(a)
    left = a.diagonal().copy()
    limit = d * _EPS * max(left, default=0.0)
    factor = np.zeros((d, d))
    open_ = np.ones(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(open_, left, -np.inf)))
        if left[p] <= limit:
            return factor[:, :k]
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        open_[p] = False
        factor[:, k] = np.where(open_, column, 0.0)
        factor[p, k] = np.sqrt(left[p])
        left = left - column * column
    return factor


def rotated(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` turned against each other until they are orthogonal.

    Every sweep meets each pair once, as in a tournament: the pairs of one round
    are disjoint and are turned together.
    """
    d, r = factor.shape
    columns = np.hstack([factor, np.zeros((d, r % 2))])
    ring = np.arange(columns.shape[1])
    for _ in range(SWEEPS if r > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            i, j = ring[:len(ring) // 2], ring[len(ring) // 2:][::-1]
            x, y = columns[:, i], columns[:, j]
            a, b, g = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a) * np.sqrt(b)
            off = np.divide(np.abs(g), size, out=np.zeros_like(g), where=size > 0)
            worst = max(worst, off.max())
            turn = off > _EPS
            zeta = np.divide(b - a, 2 * g, out=np.zeros_like(g), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            columns[:, i], columns[:, j] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= d * _EPS:
            break
    return columns[:, :r]


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues, falling, and their unit eigenvectors as columns."""
    columns = rotated(pivoted_cholesky(covariance))
    norms = np.sqrt((columns * columns).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, columns[:, order] / norms[order]


def _merge(a: tuple | None, b: tuple) -> tuple:
    """Counts, means and centred scatters of two sets to those of both."""
    if a is None:
        return b
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _covariance(fit: DataFrame, dim: int, width: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance (divisor n) of ``values`` over the fit list, centred before multiplying."""
    def packed(slot: int, state: tuple) -> pa.RecordBatch:
        n, mean, scatter = state
        body = np.concatenate([[float(n)], mean, scatter.ravel()]).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([body], pa.binary())], names=["slot", "part"])

    def unpacked(body: bytes) -> tuple:
        flat = np.frombuffer(body)
        return flat[0], flat[1:1 + width], flat[1 + width:].reshape(width, width)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                w = values(_matrix(batch.column("x"), dim))
                mean = w.mean(axis=0)
                state = _merge(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state is not None:
            yield packed(TaskContext.get().partitionId(), state)

    def merged(table: pa.Table) -> pa.Table:
        state = None
        for slot, body in sorted(zip(table["slot"].to_pylist(), table["part"].to_pylist())):
            state = _merge(state, unpacked(body))
        return pa.Table.from_batches([packed(slot // FAN_IN, state)])

    parts, left = fit.mapInArrow(folded, "slot long, part binary"), fit.rdd.getNumPartitions()
    while left > 1:  # at most FAN_IN parts to a group; the slots are numbered anew without gaps
        parts = parts.groupBy(F.floor(F.col("slot") / FAN_IN)).applyInArrow(merged, "slot long, part binary")
        left = -(-left // FAN_IN)
    n, _, scatter = unpacked(bytes(parts.collect()[0]["part"]))
    return scatter / n


def _sums(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Rows of the fit list and exact sums of each dimension."""
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            n += len(x)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # neither can overflow within a batch
            sums = [s + (int(a) << 32) + int(b) for s, a, b in zip(sums, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                                          pa.array(sums, pa.decimal128(38, 0))], names=["dim", "n", "s"])

    rows = fit.mapInArrow(folded, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return rows[0]["n"], tuple(int(r["s"]) for r in sorted(rows, key=lambda r: r["dim"]))


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows with a usable vector: no null, NaN or infinity in it."""
    entry = F.col(vector_col)
    broken = F.exists(entry, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(entry.isNotNull() & ~broken).select(
        F.col(id_col).alias("id"), F.transform(entry, lambda e: F.floor(e.cast("double") * scale)).alias("x"))


def fit_whitening(numbers: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct ``x`` once; None where nothing varies (no row, or one distinct vector)."""
    fit = materialize(numbers.select("x").distinct(), "fit_list")
    sizes = fit.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes or not sizes[0]["dim"]:
        return None
    dim = sizes[0]["dim"]
    fit = fit.filter(F.size("x") == dim)
    n, sums = _sums(fit, dim)
    mean = np.array([s / n for s in sums])
    covariance = _covariance(fit, dim, dim, lambda x: x - mean)
    values, vectors = eigen(covariance)
    values, vectors = values[:components], vectors[:, :components]
    if not len(values):
        return None
    model = Whitening(n, sums, values, vectors, float(covariance.trace()))
    error = np.abs(_covariance(fit, dim, len(values), model.project) - np.eye(len(values))).max()
    return Whitening(n, sums, values, vectors, model.trace, float(error))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum of (n x - S)^2 per row; None where it does not fit 64 bits."""
    most = n * int(max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0) + max(map(abs, sums), default=0)
    if most * most * len(sums) < 2**63:
        apart = x * n - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    totals = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
    return [t if t < 2**63 else None for t in totals]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Each entry becomes the whole number floor(scale * entry). The mean and the
    covariance are those of the distinct vectors, so repeated rows change nothing
    and get equal results, with one row each. ``whitened`` is the centred vector on
    the component over the square root of its eigenvalue; components of equal
    eigenvalue are ordered by the rotations, and the sign of one is the same in all
    rows. ``explained`` is its share of the whole variance, ``identity_error`` the
    largest entry of the whitened covariance minus the identity, measured over the
    fit list. ``deviation`` is exact, and null beyond 64 bits.

    Rows whose vector is null or holds a null, NaN or infinity are left out, and so
    are those of another length than the most frequent one (the longer of equally
    frequent ones), which live in another space. Entries beyond 64 bits count as the
    largest number. There are as many components as the covariance has rank, and no
    more than asked for: no row without data, or if all vectors are equal. A null or
    repeated id is returned as it is; other columns are ignored.
    """
    numbers = whole_numbers(vectors, id_col, vector_col, scale)
    model = fit_whitening(numbers, components)
    id_type = numbers.schema["id"].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if model is None:
        return numbers.sparkSession.createDataFrame([], schema)
    dim, k = len(model.sums), len(model.values)
    explained = model.values / model.trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            rows = np.repeat(np.arange(len(x)), k)
            far = pa.array(deviations(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(rows), model.n, np.int64)), far.take(pa.array(rows)), pa.array(model.project(x).ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return numbers.filter(F.size("x") == dim).mapInArrow(projected, schema)
