"""Signature preparation and refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prepared(signatures: DataFrame, floor: float = 1e-12, normalize: bool = True) -> DataFrame:
    """Values raised to ``floor`` and, if asked, each type scaled to add up to 1."""
    theta = F.greatest(F.col("theta"), F.lit(float(floor)))
    if normalize:
        theta = theta / F.sum(theta).over(Window.partitionBy("k"))
    return signatures.withColumn("theta", theta)


def posterior_long(posterior: DataFrame, column: str = "posterior") -> DataFrame:
    """``(..., k, q)``: one row a point and type."""
    others = [c for c in posterior.columns if c != column]
    return posterior.select(*others, F.posexplode(column).alias("k", "q"))


def weighted_counts(posterior: DataFrame, min_posterior: float = 0.0) -> DataFrame:
    """``(gene, k, n)``: posterior mass by gene and type; entries below ``min_posterior`` count 0."""
    q = F.when(F.col("q") >= min_posterior, F.col("q")).otherwise(F.lit(0.0)) if min_posterior > 0 else F.col("q")
    return posterior.groupBy("gene", "k").agg(F.sum(q).alias("n"))


def refined(
    counts: DataFrame, reference: DataFrame, current: DataFrame, prior_strength: float, rate: float = 0.25, floor: float = 1e-12,
) -> DataFrame:
    """``(gene, k, cell_type, theta, before)``: one damped Dirichlet update, scaled to add up to 1.

    With a prior strength of 0 a type without mass keeps its signature.
    """
    if prior_strength < 0 or not 0 <= rate <= 1:
        raise ValueError("prior_strength must not be negative and rate must be in [0, 1]")
    of_type = Window.partitionBy("k")
    rows = reference.select("gene", "k", "cell_type", F.col("theta").alias("base")).join(current.select("gene", "k", F.col("theta").alias("before")), ["gene", "k"])
    rows = rows.join(counts, ["gene", "k"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    mass = F.sum("n").over(of_type) + prior_strength
    mean = F.when(mass > 0, F.try_divide(F.col("n") + prior_strength * F.col("base"), mass)).otherwise(F.col("before"))
    rows = rows.withColumn("theta", F.greatest((1 - rate) * F.col("before") + rate * mean, F.lit(float(floor))))
    return rows.withColumn("theta", F.col("theta") / F.sum("theta").over(of_type)).select("gene", "k", "cell_type", "theta", "before", "n")


def update_summary(update: DataFrame) -> DataFrame:
    """``(k, effective_count, max_abs_change)`` of an update."""
    return update.groupBy("k").agg(F.sum("n").alias("effective_count"), F.max(F.abs(F.col("theta") - F.col("before"))).alias("max_abs_change"))
