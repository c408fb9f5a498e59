"""Hilbert index and order of points."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import hilbert_udf
from tessella.sources.tables import cut


def extent(df: DataFrame, coords: list[str]) -> DataFrame:
    """One row: the minimum of each coordinate and the largest extent."""
    spans = [F.max(c) - F.min(c) for c in coords]
    return df.agg(*[F.min(c).alias(f"min_{c}") for c in coords], (F.greatest(*spans) if len(spans) > 1 else spans[0]).alias("extent"))


def level_of(dims: int, level: int | None) -> int:
    """Checked bits a coordinate; by default what fits a double's 53 bits."""
    if dims not in (2, 3):
        raise ValueError("coordinates must have 2 or 3 dimensions")
    level = 53 // dims if level is None else level
    if isinstance(level, bool) or not isinstance(level, int) or not 1 <= level <= 30:
        raise ValueError("level must be an integer from 1 to 30")
    if dims * level > 63:
        raise ValueError("the index does not fit 63 bits")
    if dims * level > 53:
        warnings.warn("the index does not fit a double", stacklevel=2)
    return level


def hilbert_index(df: DataFrame, coords: list[str], level: int | None = None, out: str = "hilbert", scaled: bool = False) -> DataFrame:
    """Adds the Hilbert index; with ``scaled`` also the integer coordinates ``<name>_scaled``.

    All coordinates are scaled by the one largest extent, so the aspect is kept.  No rows: an error.
    """
    bits = level_of(len(coords), level)
    found = extent(df, coords).first()
    if found["extent"] is None:
        raise ValueError("no points")
    span, top = found["extent"], (1 << bits) - 1
    for c in coords:
        v = F.round((F.col(c) - found[f"min_{c}"]) / span * top) if span > 0 else F.lit(0.0)
        df = df.withColumn(f"{c}_scaled", F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top))).cast("bigint"))
    df = df.withColumn(out, hilbert_udf(len(coords), bits)(*[F.col(f"{c}_scaled") for c in coords]))
    return df if scaled else df.drop(*[f"{c}_scaled" for c in coords])


@dataclass(frozen=True)
class Hilbert:
    """``rows`` with ``hilbert``, ``hilbert_double`` and the scaled coordinates; minima by coordinate, extent and bits."""

    rows: DataFrame
    mins: dict[str, float]
    extent: float
    bits: int


def hilbert_result(df: DataFrame, coords: list[str], level: int | None = None) -> Hilbert:
    """The index with all that it was made from."""
    bits = level_of(len(coords), level)
    found = extent(df, coords).first()
    if found["extent"] is None:
        raise ValueError("no points")
    rows = hilbert_index(df, coords, level, scaled=True).withColumn("hilbert_double", F.col("hilbert").cast("double"))
    return Hilbert(rows, {c: found[f"min_{c}"] for c in coords}, found["extent"], bits)


#: Bits of a row's number inside its partition in ``monotonically_increasing_id``.
_ROW_BITS = 33


def row_index(df: DataFrame, by: list[str], out: str = "index", start: int = 1) -> DataFrame:
    """Adds the rank by ``by``, which must be unique, without a one-partition window.

    Rows are ranged, sorted and checkpointed once; a row's place in its partition is added to the rows of the
    partitions before, of which there is one number a partition.
    """
    ranged = cut(df.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("_row", F.monotonically_increasing_id())
    part, local = F.shiftright("_row", _ROW_BITS), F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_offset") + local + start).drop("_part", "_row", "_offset")


def hilbert_order(df: DataFrame, coords: list[str], level: int | None = None, tid: str = "tid") -> DataFrame:
    """Adds ``hilbert`` and ``index``, the 1-based rank by index and id."""
    return row_index(hilbert_index(df, coords, level), ["hilbert", tid])
