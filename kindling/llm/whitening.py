"""Whitening of embeddings: shifted CholeskyQR over the centred distinct rows, then a singular value decomposition of the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.gram import gram, matrix, pieces
from kindling.storage import saved

#: Components; entries become whole numbers of 1/SCALE, moved by OFFSET.
COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Gram passes at most; how near the identity the Gram matrix of orthonormal rows is; singular values below this share of the largest are none.
PASSES, ORTHONORMAL, RANK = 5, 1e-12, 1e-10

_SAFE = 1 << 62


def whole(entries: Column) -> Column:
    """The entries as longs floor(SCALE * c) + OFFSET; null for one that is null, not finite or too large for that."""
    return F.transform(entries, lambda c: F.when(F.abs(c.cast("double") * SCALE) < float(1 << 61), F.floor(c.cast("double") * SCALE) + OFFSET))


@dataclass(frozen=True)
class Fit:
    """Row count and exact sums of the fit list, split as sums = quotient * n + rest with 0 <= rest < n; components (rows), their eigenvalues, the trace of the covariance."""

    n: int
    quotient: list[int]
    rest: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs, or Python's integers where longs could overflow."""
        shift = np.array(self.quotient, dtype=np.int64)
        wide = self.n * (int(np.abs(x).max(initial=0)) + int(np.abs(shift).max(initial=0)) + 1) >= _SAFE
        if wide:
            return (x.astype(object) - shift.astype(object)) * self.n - np.array(self.rest, dtype=object)
        return (x - shift) * self.n - np.array(self.rest, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components.T / np.sqrt(self.eigenvalues))


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y of y @ r = x, for an upper triangular ``r``: a column at a time."""
    y = np.asfortranarray(x)
    for j in range(r.shape[0]):
        if j:
            y[:, j] -= y[:, :j] @ r[:j, j]
        y[:, j] /= r[j, j]
    return y


def squares(deviations: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None beyond a long."""
    most = int(np.abs(deviations).max(initial=0))
    if most * most * deviations.shape[1] < _SAFE:
        return (deviations.astype(np.int64) ** 2).sum(axis=1).tolist()
    sums = (deviations.astype(object) ** 2).sum(axis=1)
    return [int(s) if s < 1 << 63 else None for s in sums]


def _sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows, exact sums) of the one column of ``vectors``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            for _, part in pieces(batch.column(0), dims):
                x = matrix(part, np.int64)
                n += len(x)
                wide = int(np.abs(x).max()) * len(x) >= _SAFE
                total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims), pa.array([str(t) for t in total])], names=["dim", "n", "total"])

    parts = vectors.mapInArrow(partial, "dim int, n long, total string")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [0] * dims)


def factor(vectors: DataFrame, dims: int, centre: Fit) -> tuple[np.ndarray, np.ndarray, float]:
    """(singular values falling, right singular vectors as rows, squared Frobenius norm) of the centred rows A of ``vectors``.

    A pass adds up the Gram matrix of Q = A solved by the factors so far, and its Cholesky factor is the next one. The first is shifted by
    11 (n d + d (d + 1)) u |A|^2, so that it exists however near to singular A is; later ones are where they do not exist otherwise. Passes end once Q is orthonormal, or
    after PASSES for rows of less than full rank. With R the product of the factors and G the last Gram matrix, A'A = R'GR: the decomposition is that of G^(1/2) R.
    """
    eps = np.finfo(np.float64).eps / 2
    factors: list[np.ndarray] = []
    r, norm = np.eye(dims), 0.0
    for turn in range(PASSES):

        def rows(x: np.ndarray, known=tuple(factors)) -> np.ndarray:
            q = centre.centred(x)
            for f in known:
                q = solved(q, f)
            return q

        _, _, g = gram(vectors, dims, rows, np.int64)
        if turn == 0:
            norm = float(np.trace(g))
            if norm == 0:
                return np.zeros(dims), np.eye(dims), 0.0
        if turn == PASSES - 1 or np.abs(g - np.eye(dims)).max() < ORTHONORMAL:
            break
        shift = 11 * (centre.n * dims + dims * (dims + 1)) * eps * np.linalg.norm(g, 2)
        try:
            upper = np.linalg.cholesky(g + (shift if turn == 0 else 0) * np.eye(dims)).T
        except np.linalg.LinAlgError:
            upper = np.linalg.cholesky(g + shift * np.eye(dims)).T
        factors.append(upper)
        r = upper @ r
    w, v = np.linalg.eigh(g)
    _, s, vt = np.linalg.svd((np.sqrt(np.maximum(w, 0))[:, None] * v.T) @ r)
    return s, vt, norm


def fit_whitening(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Fit:
    """Fitted on every row of the one column of ``vectors``, distinct arrays of ``dims`` longs."""
    n, sums = _sums(vectors, dims)
    split = [divmod(s, max(1, n)) for s in sums]
    centre = Fit(n, [q for q, _ in split], [r for _, r in split], np.zeros((0, dims)), np.zeros(0), 0.0)
    if n < 2:
        return centre
    s, vt, norm = factor(vectors, dims, centre)
    k = min(components, int((s > RANK * max(s[0], 1e-300)).sum()))
    sign = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
    return Fit(n, centre.quotient, centre.rest, vt[:k] * sign[:, None], s[:k] ** 2 / n, norm / n)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(``key``, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Entries become longs (:func:`whole`); the model is fitted on each distinct vector once. Left out are vectors that are null or empty, that hold a null, a value that is not
    finite or one of 2^55 or more, or whose length is not the commonest (the greater one of equals). Every other row comes out, repeated rows and null keys too.
    Components of eigenvalue zero are none: a fit list of one vector has no component, and so no rows; an empty table neither. A component's largest entry is
    positive. ``deviation`` beyond a long is null. ``identity_error`` is measured in a pass over the fit list. Distinct vectors are written once; the
    driver and each task hold matrices of the dimensions.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("key"), whole(F.col(column)).alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull()))
    common = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    shape = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], shape).withColumnRenamed("key", key)
    dims = common["dims"]
    rows = rows.where(F.size("x") == dims)
    fitted = saved(rows.select("x").distinct())
    fit = fit_whitening(fitted, dims, components)
    k = len(fit.eigenvalues)
    error = 0.0
    if k:
        n, sums, g = gram(fitted, k, fit.whitened, np.int64)
        mean = sums / n
        error = float(np.abs(g / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(batch.column(1), dims + 8 * k) if k else ():
                x = matrix(part, np.int64)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    batch.column(0).slice(at, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                    pa.array(squares(fit.deviations(x)), pa.int64()).take(each), pa.array(fit.whitened(x).ravel()),
                    pa.array(np.tile(fit.eigenvalues / fit.trace, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, shape).withColumnRenamed("key", key)
