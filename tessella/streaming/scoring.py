"""Scoring a stream of points with a frozen field: every row is independent, so no state is kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import bcc_vertices, tri_vertices
from tessella.operators.field import LARGEST, predict
from tessella.operators.lattice import basis_kind, lattice_keys


def score_points(points: DataFrame, basis_points: DataFrame, w: np.ndarray, genes: list[str], log_theta: np.ndarray, basis: str, s: float, origin: tuple | None = None) -> DataFrame:
    """``(tid, logits, prior, posterior)`` of a stream or table with ``tid, x, y[, z], gene``.

    Vertices that the fit did not touch have coefficients 0, also those too far out for a key; genes without a signature are dropped.
    The fitted lattice is as large as ``w`` and is checked with it; a batch's vertices are looked up together in its sorted keys, its genes
    in the list of genes, which goes to every task as the signatures do.
    """
    keys = lattice_keys(basis)
    if w.size > LARGEST:
        raise ValueError("too many coefficients to send to every task")
    spots = basis_points.select(*keys, "basis_id").toArrow()
    order, known = sorted_keys([spots[k].to_numpy() for k in keys])
    shared = points.sparkSession.sparkContext.broadcast((known, spots["basis_id"].to_numpy()[order], pa.array(genes, pa.string())))
    padded = np.vstack([w, np.zeros((1, w.shape[1]))])

    def number(batches):
        known, ids, names = shared.value
        for batch in batches:
            g = pc.index_in(batch.column(1), names)
            batch, g = batch.filter(g.is_valid()), g.drop_null()
            flat = batch.column(2).flatten()
            places = [flat.field(k).to_numpy() for k in keys]
            rows = pack_keys(places)
            at = np.minimum(np.searchsorted(known, rows), max(0, len(known) - 1))
            fitted = (known[at] == rows) & within(places) if len(known) else np.zeros(len(rows), bool)
            found = np.where(fitted, ids[at] if len(known) else 0, len(padded) - 1)
            offsets = batch.column(2).offsets
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), g, pa.ListArray.from_arrays(offsets, pa.array(found, pa.int64())), pa.ListArray.from_arrays(offsets, flat.field("w"))], names=["tid", "g", "ids", "ws"]
            )

    point = [F.col(c) for c in ("x", "y", "z")[: len(keys)]]
    found = (tri_vertices if basis_kind(basis) == "2d" else bcc_vertices)(*point, s, origin or (0.0,) * len(keys))
    rows = points.select(F.col("tid").cast("bigint").alias("tid"), F.col("gene").cast("string").alias("gene"), found.alias("v"))
    return predict(rows.mapInArrow(number, "tid bigint, g int, ids array<bigint>, ws array<double>"), padded, log_theta)


def within(columns: list[np.ndarray]) -> np.ndarray:
    """Which lattice points a key can name; others would share one with a point elsewhere."""
    return np.logical_and.reduce([(c >= -(1 << 20)) & (c < 1 << 20) for c in columns])


def pack_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each lattice point: 21 bits a coordinate."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = (out << 21) | ((c.astype(np.int64) + (1 << 20)) & ((1 << 21) - 1))
    return out


def sorted_keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the lattice points by packed key, and the sorted keys; points too far out for a key raise."""
    if not within(columns).all():
        raise ValueError("lattice coordinates must lie within 2**20 of the origin")
    packed = pack_keys(columns)
    order = np.argsort(packed)
    return order, packed[order]
