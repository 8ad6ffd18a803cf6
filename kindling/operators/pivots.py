"""Bounds for exact cosine search: which groups of vectors may hold one of the best rows of a query, by angles to pivots.

The angle between unit vectors is a metric: a row at angle r from a pivot and a query at angle q from it are at least ``|q - r|`` apart.
"""

from __future__ import annotations

import numpy as np

#: Pivots of one length of vectors; vectors that they are chosen from, for each.
MAX_PIVOTS, DRAWN = 1024, 4
#: Rings of angles about a pivot.
RINGS = 8
#: A group is passed over only if its rows are this much below the least cosine that counts; above what rounding to six places can level.
MARGIN = 3e-6


def farthest_first(unit: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows of ``unit``, each the one with the least cosine to those before it."""
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break  # all others are copies of chosen ones
        chosen.append(far)
        np.maximum(near, unit @ unit[far], out=near)
    return unit[chosen]


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Cells:
    """Vectors of each known length by their nearest pivot. Zero vectors, which are at cosine 0 to all, have a cell of their own for
    each length, and vectors of other lengths share :attr:`REST`, of which nothing is known."""

    REST = -1

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots, self.first, self.zero = pivots, {}, {}
        at = 0
        for length in sorted(pivots):
            self.first[length], self.zero[length] = at, at + len(pivots[length])
            at += len(pivots[length]) + 1

    def place(self, length: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, angle to its pivot) of unit vectors of one length."""
        if length not in self.pivots:
            return np.full(len(unit), self.REST), np.zeros(len(unit))
        cosines = unit @ self.pivots[length].T
        nearest = cosines.argmax(axis=1)
        zero = ~unit.any(axis=1)
        cell = np.where(zero, self.zero[length], self.first[length] + nearest)
        return cell, np.where(zero, 0.0, angles(cosines[np.arange(len(unit)), nearest]))


class Tiles:
    """Groups of rows: the cell of each, its number of rows, and the least and greatest angle to its pivot."""

    def __init__(self, cells: Cells, cell: list[int], rows: list[int], least: list[float], most: list[float]):
        self.cells = cells
        self.cell, self.rows = np.array(cell, dtype=np.int64), np.array(rows, dtype=np.int64)
        self.least, self.most = np.array(least, dtype=float), np.array(most, dtype=float)

    def bounds(self, length: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tiles that hold rows of that length, the least angle that each query can have to a row of each, the angle to its pivot)."""
        if length not in self.cells.pivots:
            at = np.flatnonzero(self.cell == Cells.REST)
            return at, np.zeros((len(unit), len(at))), np.zeros((len(unit), len(at)))
        first, zero = self.cells.first[length], self.cells.zero[length]
        at = np.flatnonzero((self.cell >= first) & (self.cell <= zero))
        nothing = self.cell[at] == zero
        pivots = np.concatenate([self.cells.pivots[length], np.zeros((1, length))])
        to_pivot = angles(unit @ pivots[self.cell[at] - first].T)  # of a zero row: a right angle, as its cosine says
        bound = np.maximum(np.maximum(to_pivot - self.most[at], self.least[at] - to_pivot), 0.0)
        return at, np.where(nothing, to_pivot, bound), to_pivot

    def first_visits(self, length: int, unit: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the tiles to see first: the closest ones that hold ``k`` rows together (all, if there are fewer rows)."""
        at, bound, to_pivot = self.bounds(length, unit)
        if not len(at) or length not in self.cells.pivots:
            return [at] * len(unit)
        key, n = bound + 1e-3 * to_pivot, min(k, len(at))
        close = np.argpartition(key, n - 1, axis=1)[:, :n]
        close = np.take_along_axis(close, np.take_along_axis(key, close, axis=1).argsort(axis=1, kind="stable"), axis=1)
        held = self.rows[at][close].cumsum(axis=1)
        return [at[c[: int(np.searchsorted(h, k)) + 1]] for c, h in zip(close, held)]

    def later_visits(self, length: int, unit: np.ndarray, least: np.ndarray, seen: list[np.ndarray]) -> list[np.ndarray]:
        """For each query the tiles besides those ``seen`` that may hold a row of cosine ``least`` or more (NaN: any)."""
        at, bound, _ = self.bounds(length, unit)
        far = np.cos(bound) < least[:, None] - MARGIN
        return [np.setdiff1d(at[~f], s, assume_unique=True) for f, s in zip(far, seen)]
