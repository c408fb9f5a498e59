"""Reading inputs: point tables, signature matrices, sparse matrices, edge lists."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``).

    Where that is unset a folder of our own is used in local mode only; on a cluster it would be a folder
    of the driver alone, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the session's shared folder."""
    _shared_folder(df.sparkSession)
    done = df.checkpoint()
    done._files = _checkpoint_files(done)
    return done


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table written to the session's shared folder.

    A checkpoint keeps the planner's guess of its size, and where a table is made of two others that is their product: over many rounds
    it grows without end.  A written table has the size of its files.
    """
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    done._files = path
    return done


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """``cut`` of rows dealt by ``keys``; grouping or joining by them later does not move these rows again.

    The plan of a checkpoint tells how its rows are dealt only if it was not an adaptive one.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(*keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def _checkpoint_files(df: DataFrame) -> str | None:
    """Folder of a DataFrame that ``checkpoint`` returned."""
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def written_mb(df: DataFrame) -> float:
    """MB that a checkpoint (from ``cut`` or ``stored``) has on disk; 0 for others."""
    if not (files := getattr(df, "_files", None)):
        return 0.0
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(files)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength() / 2**20


def forget(*frames: DataFrame | None) -> None:
    """Deletes the files of checkpoints (from ``cut`` or ``stored``) that nothing reads any more; others are left alone."""
    for df in frames:
        if files := getattr(df, "_files", None):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(files)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            df._files = None


def events_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point table derived from ``events``: position, feature, quality and gene flag."""
    z = F.expr("timestampdiff(MICROSECOND, TIMESTAMP'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP))") / 86400000000.0
    dom = F.least(F.lit(3), F.floor(F.col("z_location") / 7.5)).cast("int")
    k = F.col("k")
    gene = (
        F.when(k % 25 == 7, "unlisted")
        .when(k % 10 < 6, F.concat(F.lit("g"), (F.col("dom") * 5 + k % 5).cast("string")))
        .otherwise(F.concat(F.lit("g"), (k % 20).cast("string")))
    )
    # filters are not moved below an explode; as a plain column the JSON was read again for each of them
    once = F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k")
    return (
        read_table(spark, sf_dir, "events")
        .select(
            F.col("event_id").cast("bigint").alias("tid"), (F.col("value") / 10.0).alias("x_location"),
            ((F.col("user_id") % 150) / 3.0).alias("y_location"), z.alias("z_location"), (F.col("event_type") != "error").alias("is_gene"), once,
        )
        .withColumn("qv", k.cast("double"))
        .withColumn("dom", dom)
        .withColumn("feature_name", gene)
        .select("tid", "x_location", "y_location", "z_location", "feature_name", "qv", "is_gene", "dom")
    )


def block_signatures(spark: SparkSession, genes: int = 20, types: int = 4) -> DataFrame:
    """Long signature matrix in which each type prefers its own block of genes; columns sum to 1."""
    own = genes // types
    g, k = F.col("g"), F.col("k")
    theta = F.when(F.floor(g / own) == k, F.lit(0.6 / own)).otherwise(F.lit(0.0)) + 0.4 / genes
    return (
        spark.range(genes).select(F.col("id").cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(types - 1))).alias("k"))
        .select(F.concat(F.lit("g"), g.cast("string")).alias("gene"), "k", F.concat(F.lit("type"), k.cast("string")).alias("cell_type"), theta.alias("theta"))
    )


def signatures_from_matrix(spark: SparkSession, matrix: np.ndarray, genes: list[str], types: list[str]) -> DataFrame:
    """Long form ``(gene, k, cell_type, theta)`` of a genes x types matrix with names."""
    rows = [(g, k, t, float(matrix[i][k])) for i, g in enumerate(genes) for k, t in enumerate(types)]
    return spark.createDataFrame(rows, "gene string, k int, cell_type string, theta double")


def signatures_wide(signatures: DataFrame) -> DataFrame:
    """One row a gene, one column a cell type."""
    return signatures.groupBy("gene").pivot("cell_type").agg(F.first("theta"))


def signatures_from_wide(wide: DataFrame, gene: str = "gene", types: list[str] | None = None) -> DataFrame:
    """Long form ``(gene, k, cell_type, theta)`` of a table with one row a gene and one column a cell type, in the order of ``types`` (all other columns).

    Genes that are null or there more than once are found by ``check_signatures``, like values that are no probabilities.
    """
    names = [c for c in wide.columns if c != gene] if types is None else types
    if not names or missing_columns(wide, [gene, *names]):
        raise ValueError("a wide signature table needs a gene column and one for each cell type")
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("cell_type"), F.col(f"`{n}`").cast("double").alias("theta")) for k, n in enumerate(names)])
    return wide.select(F.col(f"`{gene}`").cast("string").alias("gene"), F.explode(cells).alias("c")).select("gene", "c.*")


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def signature_arrays(signatures: DataFrame, value: Column | None = None) -> DataFrame:
    """``(gene, theta array)``, in the order of ``k``."""
    value = F.col("theta") if value is None else value
    packed = F.array_sort(F.collect_list(F.struct("k", value.alias("v"))))
    return signatures.groupBy("gene").agg(F.transform(packed, lambda s: s["v"]).alias("theta"))


def check_signatures(signatures: DataFrame, least_types: int = 1) -> tuple[int, list[str]]:
    """Number of genes and the names of the cell types; raises if the matrix is not valid."""
    bad = F.col("theta").isNull() | F.isnan("theta") | (F.abs("theta") == math.inf) | (F.col("theta") < 0)
    n, genes, cells, wrong, nameless = signatures.agg(
        F.count("*"), F.countDistinct("gene"), F.countDistinct("gene", "k"), F.count_if(bad), F.count_if(F.col("gene").isNull())
    ).first()
    if nameless:
        raise ValueError("signatures must name their genes")
    if wrong:
        raise ValueError("signatures must contain finite non-negative values")
    names = [r["cell_type"] for r in signatures.select("k", "cell_type").distinct().orderBy("k").collect()]
    if n != cells or cells != genes * len(names):
        raise ValueError("signatures must have one value for every gene and cell type")
    if len(names) < least_types:
        raise ValueError(f"signatures must contain at least {least_types} cell types")
    return genes, names


def coo_matrix(rows: DataFrame, row: str = "row", col: str = "col", weight: str = "weight") -> DataFrame:
    """A sparse matrix as ``(src, dst, w)``; explicit zeros stay, as in compressed formats."""
    return rows.select(F.col(row).cast("bigint").alias("src"), F.col(col).cast("bigint").alias("dst"), F.col(weight).cast("double").alias("w"))


def check_matrix(matrix: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``(src, dst, w)`` of a square matrix whose cells all lie in it, once each and with finite weights; others raise."""
    if n_rows != n_cols or n_rows < 0:
        raise ValueError("an adjacency matrix must be square")
    w = F.col("w")
    wrong = w.isNull() | F.isnan(w) | (F.abs(w) == math.inf)
    outside = ~F.coalesce(F.col("src").between(0, n_rows - 1) & F.col("dst").between(0, n_rows - 1), F.lit(False))
    bad, out, n, cells = matrix.agg(F.count_if(wrong), F.count_if(outside), F.count("*"), F.count_distinct("src", "dst")).first()
    if out:
        raise ValueError(f"{out} cells lie outside the matrix")
    if bad:
        raise ValueError("edge weights must be finite")
    if cells != n:
        raise ValueError("a cell of the matrix is there more than once")
    return matrix
