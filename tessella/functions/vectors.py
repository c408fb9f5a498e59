"""Column functions on arrays of doubles and on points."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_ln(v: Column) -> Column:
    """Logarithm with minus infinity at 0 (Spark's own is null there)."""
    return F.when(v > 0, F.ln(v)).when(v == 0, F.lit(-math.inf))


def log_sum_exp(v: Column) -> Column:
    """Stable log of the sum of exponentials of an array; minus infinity if all entries are."""
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(top == -math.inf, F.lit(-math.inf)).otherwise(top + F.ln(total))


def softmax(v: Column) -> Column:
    """Exponentials of an array, scaled to add up to 1."""
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(v, lambda x: F.exp(x - top) / total)


def argmax(v: Column) -> Column:
    """Place of the largest entry, the first of equals, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def centered(v: Column) -> Column:
    """An array minus its mean."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.transform(v, lambda x: x - mean)


def hilbert_transpose(x: list[np.ndarray], bits: int) -> np.ndarray:
    """Hilbert index of integer points (Skilling's transform, vectorised over points)."""
    x = [v.astype(np.int64).copy() for v in x]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def hilbert_udf(dims: int, bits: int) -> Callable[..., Column]:
    """Arrow function from ``dims`` integer columns to the Hilbert index."""
    if dims == 2:

        @F.pandas_udf(T.LongType())
        def index(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(hilbert_transpose([a.to_numpy(), b.to_numpy()], bits))
    else:

        @F.pandas_udf(T.LongType())
        def index(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(hilbert_transpose([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    return index


def _vertex(lattice: list[Column], weight: Column) -> Column:
    return F.struct(*[c.cast("bigint").alias(n) for c, n in zip(lattice, "ijk", strict=False)], weight.alias("w"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _snapped(vertices: Column, tol: float) -> Column:
    """An array of vertices with weights set to 0 or 1 within ``tol`` and scaled to add up to 1."""

    def snap(v: Column) -> Column:
        return v.withField("w", F.when(F.abs(v["w"]) <= tol, 0.0).when(F.abs(v["w"] - 1) <= tol, 1.0).otherwise(v["w"]))

    def scale(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda s, v: s + v["w"])
        return _let(total, lambda t: F.transform(found, lambda v: v.withField("w", F.when(F.abs(t - 1) > tol, v["w"] / t).otherwise(v["w"]))))

    return _let(F.transform(vertices, snap), scale)


def tri_vertices(x: Column, y: Column, s: float, origin: tuple[float, float] = (0.0, 0.0), tol: float = 1e-10) -> Column:
    """The three lattice vertices ``(i, j, w)`` around a point of a triangular lattice of edge ``s``."""

    def frac(d: Column) -> Column:
        return F.when(F.abs(d) <= tol, 0.0).when(F.abs(d - 1) <= tol, 1.0).otherwise(d)

    def corners(c: Column) -> Column:
        i, j, r, t = c["i"], c["j"], c["r"], c["t"]
        lower = F.array(_vertex([i, j], 1 - r - t), _vertex([i + 1, j], r), _vertex([i, j + 1], t))
        upper = F.array(_vertex([i + 1, j + 1], r + t - 1), _vertex([i, j + 1], 1 - r), _vertex([i + 1, j], 1 - t))
        return F.when(r + t <= 1 + tol, lower).otherwise(upper)

    def cell(p: Column) -> Column:
        u, v = p["u"], p["v"]
        i, j = F.floor(u), F.floor(v)
        return _let(F.struct(i.alias("i"), j.alias("j"), frac(u - i).alias("r"), frac(v - j).alias("t")), corners)

    v = 2 * (y - origin[1]) / (math.sqrt(3) * s)
    skewed = _let(v, lambda v: F.struct(((x - origin[0]) / s - v / 2).alias("u"), v.alias("v")))
    return _snapped(_let(skewed, cell), tol)


def tri_point(i: Column, j: Column, s: float, origin: tuple[float, float] = (0.0, 0.0)) -> list[Column]:
    return [F.lit(origin[0]) + s * (i + j / 2), F.lit(origin[1]) + s * math.sqrt(3) / 2 * j]


def bcc_vertices(x: Column, y: Column, z: Column, s: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), tol: float = 1e-10) -> Column:
    """The four lattice vertices ``(i, j, k, w)`` around a point of a body-centred lattice of cube edge ``s``.

    The lattice is all-even and all-odd integer triples in units of ``s / 2``.  With the offsets from
    the nearest even triple sorted by size, the tetrahedron and its weights have a closed form.
    """

    def axis(q: Column) -> Column:
        """Nearest even number, side and distance of one scaled coordinate."""
        def parts(e: Column) -> Column:
            side = F.when(q - e >= 0, 1).otherwise(-1)
            return F.struct((-F.abs(q - e)).alias("a"), e.cast("bigint").alias("e"), side.cast("bigint").alias("side"))

        return _let(2 * F.round(q / 2), parts)

    def corners(p: Column) -> Column:
        def vertices(ranked: Column) -> Column:
            top, mid, low = (-ranked[k]["a"] for k in range(3))
            first, last = ranked[0]["n"], ranked[2]["n"]
            even, side = [p[n]["e"] for n in range(3)], [p[n]["side"] for n in range(3)]
            odd = [b + d for b, d in zip(even, side, strict=True)]
            far_even = [b + F.when(first == n, 2 * d).otherwise(0) for n, (b, d) in enumerate(zip(even, side, strict=True))]
            far_odd = [b - F.when(last == n, 2 * d).otherwise(0) for n, (b, d) in enumerate(zip(odd, side, strict=True))]
            return F.array(
                _vertex(even, 1 - (top + mid) / 2), _vertex(far_even, (top - mid) / 2), _vertex(odd, (mid + low) / 2), _vertex(far_odd, (mid - low) / 2)
            )

        return _let(F.array_sort(F.transform(p, lambda v, n: F.struct(v["a"].alias("a"), n.alias("n")))), vertices)

    scaled = F.array(*[(c - o) / (s / 2) for c, o in zip((x, y, z), origin, strict=True)])
    return _snapped(_let(F.transform(scaled, axis), corners), tol)


def bcc_point(i: Column, j: Column, k: Column, s: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> list[Column]:
    return [F.lit(o) + s / 2 * c for o, c in zip(origin, (i, j, k), strict=True)]
