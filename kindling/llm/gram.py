"""Sums and Gram matrices of vectors, added up by Spark: what reaches the driver has the size of the dimensions, not of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of vectors that a task works on at once.
CELLS = 1 << 20


def matrix(lists: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Lists of one length, as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(lists), -1)


def pieces(lists: pa.Array, dims: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, lists) in runs of about CELLS cells."""
    step = max(1, CELLS // max(1, dims))
    for at in range(0, len(lists), step):
        yield at, lists.slice(at, step)


def gram(vectors: DataFrame, dims: int, turn: Callable[[np.ndarray], np.ndarray], dtype: type = np.float64) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, their sums, their Gram matrix) of ``turn`` of the rows of the one column of ``vectors``, arrays of ``dims`` without nulls.

    A task adds up its rows and gives one row per dimension; Spark brings the same dimension of all tasks together, so that neither the
    driver nor one task gets the matrices of all tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            for _, part in pieces(batch.column(0), dims):
                x = turn(matrix(part, dtype))
                n += len(x)
                sums += x.sum(axis=0)
                total += x.T @ x
        if n:
            cells = np.concatenate([np.full((dims, 1), float(n)), sums[:, None], total], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(cells))], names=["dim", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, total = None, np.zeros(dims + 2)
        for batch in batches:
            dim = batch.column(0)[0].as_py()
            total += matrix(batch.column(1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([total])], names=["dim", "cells"])

    shape = "dim int, cells array<double>"
    rows = vectors.mapInArrow(partial, shape).groupBy("dim").applyInArrow(added, shape).toArrow().sort_by("dim")
    if not rows.num_rows:
        return 0, np.zeros(dims), np.zeros((dims, dims))
    cells = matrix(rows["cells"].combine_chunks())
    return int(cells[0, 0]), cells[:, 1].copy(), cells[:, 2:].copy()
