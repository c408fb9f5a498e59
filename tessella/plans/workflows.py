"""The two labelling workflows and the stage profiler."""

from __future__ import annotations

import math
import time
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.functions.vectors import argmax, centered
from tessella.operators import field as fields
from tessella.operators import field_blocks, filters, graph, hilbert, knn, lattice, potts, signatures
from tessella.operators.filters import Columns
from tessella.sources.tables import check_signatures, coo_matrix, cut, forget, signature_arrays, stored, written_mb


@dataclass
class CrfResult:
    """Labelled rows, marginals, and how belief propagation ended."""

    labels: DataFrame
    marginals: DataFrame
    edges: DataFrame
    iterations: int
    max_delta: float | None
    mean_delta: float | None
    history: list = field(default_factory=list)


def begin(spark: SparkSession, stage: str, verbose: bool) -> None:
    """Names the jobs of a stage, and says so if asked."""
    spark.sparkContext.setJobDescription(stage)
    if verbose:
        print(f"{stage} ...", flush=True)


def filtered(df: DataFrame, signature: DataFrame, columns: Columns, qv_threshold: float) -> DataFrame:
    """The filtered rows, checkpointed; rows left out because their gene has no signature are counted in the same pass and told of.

    No rows left: an error.
    """
    counts = Observation()
    points = cut(filters.transcripts(df, signature, columns, qv_threshold, counts))
    n, known = counts.get["n"], counts.get["n_known"]
    if known < n:
        warnings.warn(f"only {known} of {n} rows have genes with a signature; the others are left out", stacklevel=3)
    if not known:
        raise ValueError("no rows remain after filtering")
    return points


def neighbour_graph(points: DataFrame, k: int, radius: float, ratio: float) -> DataFrame:
    """Undirected edges (u, v, w) of the union of everyone's nearest neighbours."""
    if not (math.isfinite(ratio) and ratio > 0):
        raise ValueError("same_label_ratio must be positive and finite")
    near = graph.with_weight(knn.knn_edges(points, k, radius), math.log(ratio))
    return near.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "w").distinct()


def placed(points: DataFrame) -> DataFrame:
    """With the Hilbert index of the coordinates as ``place``, by which belief propagation deals nodes."""
    return hilbert.hilbert_index(points, [c for c in "xyz" if c in points.columns], 15, out="place")


def named_labels(probabilities: DataFrame, names: list[str], column: str = "p") -> DataFrame:
    """Adds ``label_k`` and ``label``, the most probable type (the first of equals)."""
    best = argmax(F.col(column))
    return probabilities.withColumn("label_k", best).withColumn("label", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("label_k") + 1))


def run_crf(
    df: DataFrame, signature: DataFrame, columns: Columns = Columns(), qv_threshold: float = 20, n_neighbors: int = 10, dist_threshold: float = 2,
    same_label_ratio: float = 5, tol: float = 0.1, max_iter: int = 50, damping: float = 1.0, with_order: bool = True, verbose: bool = False, schedule: str = "sync",
) -> CrfResult:
    """Filter, order along the Hilbert curve, join neighbours, propagate beliefs (by ``schedule``), label.

    The order gives ``hilbert`` and ``index`` and is not needed for the labels.
    """
    spark = df.sparkSession
    _, names = check_signatures(signature)
    begin(spark, "filtering rows", verbose)
    points = filtered(df, signature, columns, qv_threshold)
    begin(spark, "joining neighbours", verbose)
    edges = stored(neighbour_graph(points, n_neighbors, dist_threshold, same_label_ratio))
    phi = stored(potts.node_potentials(placed(points), signature))
    begin(spark, "propagating beliefs", verbose)
    found = potts.belief_propagation(edges, phi, len(names), max_iter, damping, tol, schedule, verbose=verbose)
    begin(spark, "ordering and labelling rows", verbose)
    rows = hilbert.hilbert_order(points, ["x", "y"]) if with_order else points
    labels = rows.join(named_labels(found.marginals, names).withColumnRenamed("node", "tid"), "tid").drop("p")
    return CrfResult(labels, found.marginals, edges, found.iterations, found.max_delta, found.mean_delta, found.history)


def matrix_beliefs(cells: DataFrame, n_rows: int, n_cols: int, phi: DataFrame, types: int, drop_diagonal: bool = True, **options) -> potts.Beliefs:
    """Belief propagation on the graph of a sparse matrix ``cells`` (row, col, weight) from the potentials ``phi`` (node, phi).

    The matrix must be square, with finite weights and each cell once, and symmetric: a cell without its opposite, or with another weight there, raises;
    so does a cell of the diagonal that is not dropped.  ``options`` are those of ``belief_propagation``.
    """
    if n_rows != n_cols or n_rows < 0:
        raise ValueError("an adjacency matrix must be square")
    pairs = stored(matrix_pairs(coo_matrix(cells), n_rows))
    bad, outside, twice, alone, uneven, own = pairs.agg(
        F.sum("bad"), F.sum("outside"), F.count_if((F.col("there") > 1) | (F.col("back") > 1) | (F.col("own") > 1)), F.count_if(F.col("there") != F.col("back")),
        2 * F.count_if((F.col("there") == F.col("back")) & (F.col("w") != F.col("_top"))), F.sum("own"),
    ).first()
    if outside:
        raise ValueError(f"{outside} cells lie outside the matrix")
    if bad:
        raise ValueError("edge weights must be finite")
    if twice:
        raise ValueError("a cell of the matrix is there more than once")
    if alone:
        raise ValueError(f"{alone} edges have no reverse edge")
    if uneven:
        raise ValueError(f"{uneven} edges differ in weight from their reverse")
    if own and not drop_diagonal:
        raise ValueError("an edge leads from a node to itself")
    found = potts.belief_propagation(pairs.where("u < v").select("u", "v", "w"), phi, types, **options)
    forget(pairs)
    return found


def matrix_pairs(matrix: DataFrame, n: int) -> DataFrame:
    """``(u, v, w, _top, there, back, own, bad, outside)``: a cell and its opposite in one row, with their least and largest weight and counts: cells above, below and on
    the diagonal, cells without a finite weight, and cells outside ``n`` rows and columns.  The matrix is read once."""
    src, dst, w = F.col("src"), F.col("dst"), F.col("w")
    inside = F.coalesce(src.between(0, n - 1) & dst.between(0, n - 1), F.lit(False))
    wrong = w.isNull() | F.isnan(w) | (F.abs(w) == math.inf)
    return matrix.groupBy(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).agg(
        F.min("w").alias("w"), F.max("w").alias("_top"), F.count_if(src < dst).alias("there"), F.count_if(src > dst).alias("back"), F.count_if(src == dst).alias("own"),
        F.count_if(wrong).alias("bad"), F.count_if(~inside).alias("outside"),
    )


@dataclass
class BasisResult:
    """Everything a basis fit yields; rows of points are DataFrames.

    ``basis_weights`` is a matrix, or ``(basis_id, w)`` after a fit in blocks.
    """

    labels: DataFrame
    prediction: DataFrame
    basis_points: DataFrame
    basis_edges: DataFrame
    basis_weights: np.ndarray | DataFrame
    fit: fields.Fit | field_blocks.BlockedFit
    fits: list
    signatures_initial: DataFrame
    signatures: DataFrame
    signature_history: list
    update_history: list


@dataclass
class FieldProblem:
    """A point table on a lattice, ready for the objective: ``edges`` as arrays, or all in ``blocks``."""

    points: DataFrame
    genes: DataFrame
    basis: DataFrame
    lattice_edges: DataFrame
    edges: tuple | None
    log_theta: np.ndarray
    n_basis: int
    blocks: field_blocks.BlockedField | None = None


def field_problem(points: DataFrame, signature: DataFrame, basis: str, s: float, origin: tuple | None = None, blocked: bool | None = None, span: int | None = None, by_appearance: bool = False) -> FieldProblem:
    """Vertices, basis ids, lattice edges and the log signature matrix of filtered points.

    ``by_appearance`` numbers lattice points as they appear, takes the first tetrahedron that fits and, with it, the subset of edges that hangs
    on these ids.  ``blocked`` keeps lattice and points in blocks (of ``span`` lattice points); by default that is done where the driver cannot hold the coefficients.
    """
    order = hilbert.row_index(signature_arrays(signature).select("gene"), ["gene"], "g", start=0).withColumn("g", F.col("g").cast("int"))
    genes = cut(points.select("tid", "gene").join(order, "gene").select("tid", "gene", "g"))
    vertices = lattice.barycentric(points.select("tid", "x", "y", *(["z"] if "z" in points.columns else [])), basis, s, origin=origin, first_fit=by_appearance)
    spots = cut(lattice.basis_points(vertices, basis, s, origin, by_appearance))
    links = cut(lattice.lattice_edges(spots, basis, s, every=not by_appearance))
    n = spots.count()
    types = signature.select("k").distinct().count()
    table = cut(fields.points_table(lattice.design(vertices, spots, basis), genes.select("tid", "g")))
    log_theta = log_matrix(signature)
    if blocked or blocked is None and n * types > fields.LARGEST:
        return FieldProblem(table, genes, spots, links, None, log_theta, n, field_blocks.blocked_field(table, links, n, types, span))
    number = links.toArrow()
    edges = tuple(number[c].to_numpy() for c in ("m1", "m2", "distance"))
    return FieldProblem(table, genes, spots, links, edges, log_theta, n)


def log_matrix(signature: DataFrame) -> np.ndarray:
    """Genes (by name) x types (by k), logarithms; minus infinity for 0."""
    rows = signature_arrays(signature).orderBy("gene").toArrow()["theta"].to_pylist()
    with np.errstate(divide="ignore"):
        return np.log(np.array(rows, float))


def spatial_basis(
    df: DataFrame, signature: DataFrame, s: float, basis: str = "3d", columns: Columns = Columns(), qv_threshold: float = 20, origin: tuple | None = None,
    penalty: fields.Penalty = fields.Penalty(), signature_floor: float = 1e-12, normalize_signatures: bool = True, refine_signatures: bool = False,
    signature_update_iters: int = 1, signature_prior_strength: float | None = None, signature_update_rate: float = 0.25, signature_min_posterior: float = 0.0,
    maxit: int = 100, refinement_maxit: int | None = None, reltol: float = 1e-6, verbose: bool = False, by_appearance: bool = False,
) -> BasisResult:
    """Filter, interpolate on a lattice, fit the field, refine signatures if asked, label.

    More coefficients than the driver can hold are fitted in blocks (``field_blocks``), by the same steps.  ``by_appearance``: see ``field_problem``.
    """
    lattice.basis_kind(basis)
    lattice.check_edge(s)
    if signature_floor <= 0 or maxit < 1 or reltol <= 0 or signature_update_iters < 1:
        raise ValueError("signature_floor, maxit, reltol and signature_update_iters must be positive")
    n_genes, names = check_signatures(signature, least_types=2)
    begin(df.sparkSession, "filtering rows", verbose)
    points = filtered(df, signature, columns, qv_threshold)
    first = cut(signatures.prepared(signature, signature_floor, normalize_signatures))
    begin(df.sparkSession, "interpolating on the lattice", verbose)
    problem = field_problem(points, first, basis, s, origin, by_appearance=by_appearance)
    strength = n_genes if signature_prior_strength is None else signature_prior_strength
    current, blocks = first, problem.blocks
    w = np.zeros((problem.n_basis, len(names))) if blocks is None else field_blocks.zero_blocks(blocks)
    fits, history, updates = [], [first], []
    rounds = signature_update_iters if refine_signatures else 0

    def predict(theta: np.ndarray) -> DataFrame:
        return fields.predict(problem.points, w, theta) if blocks is None else field_blocks.predict_blocks(blocks, w, theta)

    for turn in range(rounds + 1):
        log_theta = log_matrix(current)
        begin(df.sparkSession, f"fitting the field, round {turn}", verbose)
        most = maxit if turn == 0 else (refinement_maxit or maxit)
        if blocks is None:
            fit = fields.minimize(lambda v, t=log_theta: fields.objective(problem.points, v, t, problem.edges, penalty), w, most, reltol)
        else:
            fit = field_blocks.minimize_blocks(blocks, log_theta, penalty, w, most, reltol)
        fits.append(fit)
        w = fit.w
        if turn < rounds:
            q = signatures.posterior_long(predict(log_theta).join(problem.genes, "tid").select("gene", "posterior"))
            update = cut(signatures.refined(signatures.weighted_counts(q, signature_min_posterior), first, current, strength, signature_update_rate, signature_floor))
            updates.append(signatures.update_summary(update))
            current = update.select("gene", "k", "cell_type", "theta")
            history.append(current)
    prediction = predict(log_matrix(current))
    labels = points.join(named_labels(prediction.select("tid", "posterior"), names, "posterior"), "tid").drop("posterior")
    centred = w - w.mean(axis=1, keepdims=True) if blocks is None else centered_rows(field_blocks.coefficient_rows(w, blocks))
    return BasisResult(labels, prediction, problem.basis, problem.lattice_edges, centred, fits[-1], fits, first, current, history, updates)


def minimum_slice(points: DataFrame, signature: DataFrame) -> DataFrame:
    """``(node, p)``: the posterior without neighbours, softmax of the log signature row."""
    from tessella.functions.vectors import softmax

    return potts.node_potentials(points, signature).select("node", softmax(F.col("phi")).alias("p"))


def centered_rows(w: DataFrame, column: str = "w") -> DataFrame:
    """Coefficient rows minus their mean over types."""
    return w.withColumn(column, centered(F.col(column)))


def profile_crf(
    df: DataFrame, signature: DataFrame, columns: Columns = Columns(), qv_threshold: float = 20, n_neighbors: int = 10, dist_threshold: float = 2,
    same_label_ratio: float = 5, tol: float = 0.1, max_iter: int = 50, damping: float = 1.0,
) -> DataFrame:
    """``(stage, seconds, n_rows, size_mb, total_mb, peak_mb, source, n_nodes, n_labels, n_directed_edges, n_candidate_directed_edges, lbp_lower_bound_mb)``.

    Runs each stage of ``run_crf`` to its end.  ``size_mb`` is the optimizer's estimate of what a stage yields, ``total_mb``
    what it wrote to the shared folder and ``peak_mb`` the most heap that the driver used in it (its memory pools'
    peaks); ``source`` names that measure.
    """
    spark = df.sparkSession
    rows: list[tuple] = []
    pools = list(spark._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans())

    def stage(name: str, make):
        for pool in pools:
            pool.resetPeakUsage()
        began = time.time()
        out = stored(make())
        n = out.count()
        size = float(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 2**20
        seconds = time.time() - began
        peak = sum(pool.getPeakUsage().getUsed() for pool in pools if str(pool.getType().name()) == "HEAP") / 2**20
        rows.append((name, seconds, n, size, written_mb(out), peak, "checkpoint files, JVM memory pools"))
        return out

    _, names = check_signatures(signature)
    points = stage("filter", lambda: filters.transcripts(df, signature, columns, qv_threshold))
    forget(stage("hilbert_sort", lambda: hilbert.hilbert_order(points, ["x", "y"])))
    near = stage("knn", lambda: knn.knn_edges(points, n_neighbors, dist_threshold))
    weight = math.log(same_label_ratio)
    edges = stage("graph_build", lambda: near.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.lit(weight).alias("w")).distinct())
    forget(near)
    phi = stage("node_potentials", lambda: potts.node_potentials(placed(points), signature))
    stage("lbp", lambda: potts.belief_propagation(edges, phi, len(names), max_iter, damping, tol).marginals)
    n, e, candidates = rows[0][2], 2 * rows[3][2], 2 * rows[2][2]
    bound = potts.estimate_lbp_memory_mb(n, len(names), e)
    return spark.createDataFrame(
        [(*r, n, len(names), e, candidates, bound) for r in rows],
        "stage string, seconds double, n_rows bigint, size_mb double, total_mb double, peak_mb double, source string, n_nodes bigint, n_labels int, n_directed_edges bigint, n_candidate_directed_edges bigint, lbp_lower_bound_mb double",
    )
