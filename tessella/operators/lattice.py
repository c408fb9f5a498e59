"""Barycentric bases: vertices and weights of points, the design and the lattice graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.tetrahedra import first_tetrahedra
from tessella.functions.vectors import bcc_point, bcc_vertices, tri_point, tri_vertices
from tessella.operators.hilbert import row_index

#: One offset of each pair of opposite neighbours, and its length for edge 1.
TRI_OFFSETS = [((1, 0), 1.0), ((0, 1), 1.0), ((1, -1), 1.0)]
BCC_OFFSETS = [((2, 0, 0), 1.0), ((0, 2, 0), 1.0), ((0, 0, 2), 1.0)] + [((1, a, b), math.sqrt(3) / 2) for a in (-1, 1) for b in (-1, 1)]


def basis_kind(basis: str) -> str:
    """'2d' or '3d' for the names and aliases of the bases."""
    kind = {"2d": "2d", "tri": "2d", "3d": "3d", "bcc": "3d"}.get(str(basis).lower())
    if kind is None:
        raise ValueError("basis must be one of '3d', '2d', 'tri', 'bcc'")
    return kind


def lattice_keys(basis: str) -> list[str]:
    return ["i", "j"] if basis_kind(basis) == "2d" else ["i", "j", "k"]


def check_edge(s: float) -> None:
    if not (isinstance(s, (int, float)) and math.isfinite(s) and s > 0):
        raise ValueError("s must be a positive finite number")


def checked_weights(vertices: Column, tol: float = 1e-6) -> Column:
    """The vertices of a point, whose weights must be finite and add up to 1; others raise when read."""
    def check(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda t, x: t + x["w"])
        wrong = F.raise_error(F.lit("a point lies in no cell of the lattice: its weights do not add up to 1"))
        return F.when(F.coalesce(F.abs(total - 1) <= tol, F.lit(False)) & ~F.isnan(total), v).otherwise(wrong)

    # bound to a variable, so that the vertices are computed once
    return F.transform(F.array(vertices), check)[0]


def barycentric(
    df: DataFrame, basis: str, s: float, coords: tuple[str, ...] = ("x", "y", "z"), origin: tuple[float, ...] | None = None, tol: float = 1e-10, first_fit: bool = False
) -> DataFrame:
    """``df`` with ``slot``, the lattice key and ``w``: one row a point and vertex.

    On faces of tetrahedra several hold a point, with equal weights but other vertices of weight 0; ``first_fit`` takes the first one in
    the order of a search over the corners around the point (``first_tetrahedra``).
    """
    check_edge(s)
    kind, keys = basis_kind(basis), lattice_keys(basis)
    d = len(keys)
    origin = origin or (0.0,) * d
    if len(origin) != d or not all(map(math.isfinite, origin)):
        raise ValueError(f"origin must have {d} finite numbers")
    point = [F.col(c) for c in coords[:d]]
    found = tri_vertices(*point, s, origin, tol) if kind == "2d" else (first_tetrahedra(s, origin, tol)(*point) if first_fit else bcc_vertices(*point, s, origin, tol))
    found = checked_weights(found)
    return df.select("*", F.posexplode(found).alias("slot", "_v")).select(*df.columns, "slot", *[F.col(f"_v.{c}").alias(c) for c in (*keys, "w")])


def lattice_points(vertices: DataFrame, basis: str, s: float, origin: tuple[float, ...] | None = None) -> DataFrame:
    """Adds the physical place ``px, py[, pz]`` of a vertex."""
    keys = lattice_keys(basis)
    origin = origin or (0.0,) * len(keys)
    cols = [F.col(k) for k in keys]
    place = tri_point(*cols, s, origin) if len(keys) == 2 else bcc_point(*cols, s, origin)
    return vertices.withColumns({n: c for n, c in zip(("px", "py", "pz"), place, strict=False)})


def basis_points(vertices: DataFrame, basis: str, s: float, origin: tuple[float, ...] | None = None, by_appearance: bool = False, row: str = "tid") -> DataFrame:
    """Distinct lattice points with ``basis_id``, from 0: by lattice order, or by first appearance among all first vertices in the order
    of ``row``, then all second ones, and so on."""
    keys = lattice_keys(basis)
    if by_appearance:
        seen = vertices.groupBy(*keys).agg(F.min(F.struct("slot", F.col(row).alias("row"))).alias("_seen")).select(*keys, "_seen.*")
        points = row_index(seen, ["slot", "row"], "basis_id", start=0).drop("slot", "row")
    else:
        points = row_index(vertices.select(*keys).distinct(), keys, "basis_id", start=0)
    return lattice_points(points, basis, s, origin)


def design(vertices: DataFrame, points: DataFrame, basis: str, tid: str = "tid") -> DataFrame:
    """``(tid, slot, basis_id, w)``."""
    keys = lattice_keys(basis)
    return vertices.join(points.select(*keys, "basis_id"), keys).select(tid, "slot", "basis_id", "w")


def lattice_edges(points: DataFrame, basis: str, s: float, every: bool = True) -> DataFrame:
    """Undirected edges between two touched lattice points, once: ``(m1, m2, distance)``.

    Without ``every``, edges of the triangular lattice and along the axes are left out where the id falls in the direction of their offset,
    so that the set depends on how lattice points are numbered; diagonals stay.
    """
    keys = lattice_keys(basis)
    offsets = TRI_OFFSETS if len(keys) == 2 else BCC_OFFSETS
    moves = F.explode(F.array(*[F.struct(*[F.lit(a).alias(k) for a, k in zip(o, keys, strict=True)], F.lit(d * s).alias("d"), F.lit(d == 1.0).alias("one_way")) for o, d in offsets]))
    ahead = points.select("basis_id", *keys, moves.alias("o")).select(
        F.col("basis_id").alias("a"), *[(F.col(k) + F.col(f"o.{k}")).alias(k) for k in keys], F.col("o.d").alias("distance"), F.col("o.one_way").alias("one_way")
    )
    pairs = ahead.join(points.select(F.col("basis_id").alias("b"), *keys), keys)
    if not every:
        pairs = pairs.where(~F.col("one_way") | (F.col("a") < F.col("b")))
    return pairs.select(F.least("a", "b").alias("m1"), F.greatest("a", "b").alias("m2"), "distance")
