"""Graphs for belief propagation: checked, symmetric, with reverse edges and row pointers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.hilbert import row_index


def with_weight(edges: DataFrame, weight: float | str) -> DataFrame:
    """``(src, dst, w)`` with one weight for all, or that of a column."""
    return edges.select("src", "dst", (F.col(weight) if isinstance(weight, str) else F.lit(float(weight))).alias("w"))


def check_edges(edges: DataFrame, n_nodes: int | None = None, first: int = 0) -> None:
    """Raises on null or non-finite weights and on endpoints outside ``first .. first + n_nodes - 1``."""
    w = F.col("w")
    wrong = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    out = F.col("src").isNull() | F.col("dst").isNull()
    if n_nodes is not None:
        last = first + n_nodes - 1
        out = out | ~F.col("src").between(first, last) | ~F.col("dst").between(first, last)
    bad, outside = edges.agg(F.count_if(wrong), F.count_if(out)).first()
    if bad:
        raise ValueError("edge weights must be finite")
    if outside:
        raise ValueError("edge endpoints are out of range")


def directed(edges: DataFrame, symmetric: bool = False, drop_diagonal: bool = False) -> DataFrame:
    """Distinct directed edges, both ways if ``symmetric``; unequal weights of one edge raise."""
    if drop_diagonal:
        edges = edges.where("src <> dst")
    if symmetric:  # both ways are one group, the smaller id (or null) first, and become two rows after it
        turned = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNotNull())
        edges = edges.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), "w")
    merged = edges.groupBy("src", "dst").agg(F.min("w").alias("w"), F.max("w").alias("_top"))
    clash = F.raise_error(F.lit("an edge has different weights"))
    merged = merged.select("src", "dst", F.when(F.col("w") == F.col("_top"), F.col("w")).otherwise(clash.cast("double")).alias("w"))
    if not symmetric:
        return merged
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(there)).otherwise(F.array(there, back))
    return merged.select(F.explode(ways).alias("e"), "w").select("e.*", "w")


def reverse_edges(edges: DataFrame, check_reverse: bool = True) -> DataFrame:
    """``(edge_id, src, dst, w, rev_id)``: edges numbered by (src, dst), each with its opposite.

    A missing opposite raises, or is null without ``check_reverse``.
    """
    numbered = row_index(edges, ["src", "dst"], "edge_id", start=0)
    back = numbered.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("edge_id").alias("rev_id"))
    joined = numbered.join(back, ["src", "dst"], "left").select("edge_id", "src", "dst", "w", "rev_id")
    if check_reverse:
        none = F.raise_error(F.lit("an edge has no reverse edge")).cast("bigint")
        joined = joined.withColumn("rev_id", F.when(F.col("rev_id").isNull(), none).otherwise(F.col("rev_id")))
    return joined


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, degree)`` for every node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(out, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def row_pointers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, start)``: number of edges of the nodes before; an exclusive prefix sum.

    Sums run over each range partition, and the sums of the partitions before are added.
    """
    d = degrees(edges, nodes).repartitionByRange("node").withColumn("_part", F.spark_partition_id())
    from tessella.sources.tables import cut

    d = cut(d)
    inside = F.coalesce(F.sum("degree").over(Window.partitionBy("_part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = d.groupBy("_part").agg(F.sum("degree").alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return d.withColumn("_inside", inside).join(F.broadcast(parts), "_part").select("node", (F.col("_offset") + F.col("_inside")).alias("start"))


@dataclass(frozen=True)
class Csr:
    """A graph by rows: ``pointers`` (node, start) with a last row of the next node's number and the number of edges,
    ``edges`` (edge_id, src, dst, w, rev_id) in that order, and both counts."""

    pointers: DataFrame
    edges: DataFrame
    n_nodes: int
    n_edges: int


def csr(edges: DataFrame, nodes: DataFrame, check_reverse: bool = True) -> Csr:
    """The graph of directed ``edges`` (src, dst, w) on ``nodes`` (node), checked and numbered."""
    check_edges(edges)
    strangers = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti").unionByName(edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if not strangers.isEmpty():
        raise ValueError("edge endpoints are out of range")
    n_nodes, last = nodes.agg(F.count("*"), F.max("node")).first()
    n_edges = edges.count()
    end = edges.sparkSession.createDataFrame([((-1 if last is None else last) + 1, n_edges)], "node bigint, start bigint")
    return Csr(row_pointers(edges, nodes).unionByName(end), reverse_edges(edges, check_reverse), n_nodes, n_edges)


def undirected(edges: DataFrame) -> DataFrame:
    """``(u, v, w)`` with u < v, once an edge: what belief propagation keeps its two messages on."""
    return edges.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")
