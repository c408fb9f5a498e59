"""The tetrahedra of a body-centred lattice around a point, in the order of a search over corners.

Around a point there are eight corners of all-even and eight of all-odd coordinates.  Which four of them are a tetrahedron of the lattice
depends only on where the odd corners lie beside the even ones, one of eight cases; for each case these sets of four are found once, and
points of a batch are tried against them together.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared lengths of a tetrahedron's edges, sorted.
EDGES = [3, 3, 3, 3, 4, 4]
_VERTEX = "array<struct<i:bigint,j:bigint,k:bigint,w:double>>"


def corners(side: tuple[int, int, int]) -> np.ndarray:
    """The sixteen corners from the lower even one: even ones first, in each the last axis fastest; ``side`` is 1 or -1 an axis,
    how far the lower odd corner is from the lower even one."""
    steps = np.array(list(itertools.product((0, 2), repeat=3)))
    return np.vstack([steps, steps + np.array(side)])


@functools.cache
def tetrahedra(side: tuple[int, int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Corners (4 x 3) and the matrix that gives weights from (x, y, z, 1), in the order of the search."""
    found = []
    at = corners(side)
    for four in itertools.combinations(range(16), 4):
        v = at[list(four)]
        if sorted(int(((a - b) ** 2).sum()) for a, b in itertools.combinations(v, 2)) == EDGES:
            found.append((v, np.linalg.inv(np.vstack([v.T, np.ones(4)]))))
    return found


def first_fit(q: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (n x 4 x 3) and weights (n x 4) of scaled points, by the first tetrahedron that holds each."""
    even = 2 * np.floor(q / 2)
    side = np.where(q - even >= 1, 1, -1)  # the largest odd number that is not above the point
    vertices, weights = np.zeros((len(q), 4, 3)), np.full((len(q), 4), np.nan)
    for case in itertools.product((-1, 1), repeat=3):
        rest = np.flatnonzero((side == case).all(axis=1))
        for v, solve in tetrahedra(case):
            if not len(rest):
                break
            w = np.column_stack([q[rest] - even[rest], np.ones(len(rest))]) @ solve.T
            fits = ((w >= -tol) & (w <= 1 + tol)).all(axis=1)
            vertices[rest[fits]], weights[rest[fits]] = v + even[rest[fits], None, :], w[fits]
            rest = rest[~fits]
    snapped = np.where(np.abs(weights) <= tol, 0.0, np.where(np.abs(weights - 1) <= tol, 1.0, weights))
    total = snapped.sum(axis=1, keepdims=True)
    return vertices, np.where(np.abs(total - 1) > tol, snapped / total, snapped)


def first_tetrahedra(s: float, origin: tuple[float, float, float], tol: float) -> Callable[..., Column]:
    """Arrow function from three coordinates to the vertices ``(i, j, k, w)`` of the first tetrahedron that holds the point."""

    @F.pandas_udf(_VERTEX)
    def found(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        q = (np.column_stack([x, y, z]) - np.array(origin)) / (s / 2)
        v, w = first_fit(q, tol)
        return pd.Series([[{"i": int(a), "j": int(b), "k": int(c), "w": float(e)} for (a, b, c), e in zip(p, u, strict=True)] for p, u in zip(v, w, strict=True)])

    return found
