"""Row filters of the labelling workflows."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Names of the caller's columns."""

    x: str = "x_location"
    y: str = "y_location"
    z: str = "z_location"
    gene: str = "feature_name"
    qv: str = "qv"
    is_gene: str = "is_gene"
    tid: str = "tid"


def quality(df: DataFrame, qv: str = "qv", threshold: float = 20) -> DataFrame:
    """Rows of at least that quality, null dropped; all rows, with a warning, if there is no such column."""
    if qv not in df.columns:
        warnings.warn(f"column '{qv}' not found: no quality filter", stacklevel=2)
        return df
    return df.where(F.col(qv) >= threshold)


def gene_rows(df: DataFrame, is_gene: str = "is_gene") -> DataFrame:
    """Rows flagged TRUE; the column must be BOOLEAN."""
    if is_gene not in df.columns:
        warnings.warn(f"column '{is_gene}' not found: no gene filter", stacklevel=2)
        return df
    if not isinstance(df.schema[is_gene].dataType, T.BooleanType):
        raise ValueError(f"column '{is_gene}' must be BOOLEAN")
    return df.where(F.col(is_gene))


def known_genes(df: DataFrame, signatures: DataFrame, gene: str = "feature_name") -> DataFrame:
    """Rows whose gene has a signature (a semi join; null genes go)."""
    genes = signatures.select(F.col("gene").alias(gene)).distinct()
    return df.join(genes, gene, "left_semi").select(*df.columns)


def transcripts(df: DataFrame, signatures: DataFrame, columns: Columns = Columns(), qv_threshold: float = 20, counts: Observation | None = None) -> DataFrame:
    """The three filters in turn, with columns named ``tid, x, y, z, gene`` and the others as they are.

    Non-finite coordinates raise when rows are read.  ``counts`` observes, in the same pass, the rows before the last filter (``n``) and after it (``n_known``).
    """
    rows = gene_rows(quality(df, columns.qv, qv_threshold), columns.is_gene)
    if counts is None:
        kept = known_genes(rows, signatures, columns.gene)
    else:
        genes = signatures.select(F.col("gene").alias(columns.gene)).distinct().withColumn("_known", F.lit(True))
        told = rows.join(genes, columns.gene, "left").observe(counts, F.count("*").alias("n"), F.count_if(F.coalesce("_known", F.lit(False))).alias("n_known"))
        kept = told.where("_known").select(*df.columns)
    finite = [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(F.col(c)) for c in (columns.x, columns.y, columns.z) if c in df.columns]
    ok = finite[0]
    for f in finite[1:]:
        ok = ok & f
    x = F.when(ok, F.col(columns.x)).otherwise(F.raise_error(F.lit("coordinates must be finite")))
    named = {columns.tid: "tid", columns.y: "y", columns.z: "z", columns.gene: "gene"}
    others = [c for c in df.columns if c not in (*named, columns.x)]
    return kept.select(x.cast("double").alias("x"), *[F.col(a).alias(b) for a, b in named.items() if a in df.columns], *others)


def filter_counts(df: DataFrame, signatures: DataFrame, columns: Columns = Columns(), qv_threshold: float = 20) -> DataFrame:
    """Rows left after each filter, in one pass."""
    genes = signatures.select(F.col("gene").alias(columns.gene)).distinct().withColumn("_known", F.lit(True))
    good = F.coalesce(F.col(columns.qv) >= qv_threshold, F.lit(False))
    flagged = good & F.coalesce(F.col(columns.is_gene), F.lit(False))
    return df.join(genes, columns.gene, "left").agg(
        F.count("*").alias("n_rows"), F.count_if(good).alias("n_quality"), F.count_if(flagged).alias("n_gene"),
        F.count_if(flagged & F.coalesce("_known", F.lit(False))).alias("n_known"),
    )


def known_counts(df: DataFrame, signatures: DataFrame, gene: str = "feature_name") -> tuple[int, int]:
    """Rows, and those whose gene has a signature."""
    genes = signatures.select(F.col("gene").alias(gene)).distinct().withColumn("_known", F.lit(True))
    return tuple(df.join(genes, gene, "left").agg(F.count("*"), F.count_if(F.coalesce("_known", F.lit(False)))).first())
