"""Registered queries of the spatial operators and the DuckDB SQL that gives the same rows.

Points and signatures come from ``events`` (see ``sources.tables``).  Results are long rows with
doubles rounded to 6 places; ties are broken by ids.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import argmax, centered, log_sum_exp, softmax
from tessella.operators import field as fields
from tessella.operators import field_blocks, filters, graph, hilbert, knn, lattice, potts, signatures
from tessella.plans import workflows
from tessella.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RADIUS, NEIGHBOURS, RATIO, EDGE, LEVEL = 2.0, 10, 5.0, 8.0, 10

T_SQL = """raw AS (SELECT event_id AS tid, value / 10.0 AS x, (user_id % 150) / 3.0 AS y,
    (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS z, CAST(json_extract_string(props, '$.k') AS INTEGER) AS kk, event_type FROM events),
raw2 AS (SELECT *, LEAST(3, CAST(floor(z / 7.5) AS INTEGER)) AS dom FROM raw),
t AS (SELECT tid, x, y, z, dom, CAST(kk AS DOUBLE) AS qv, event_type <> 'error' AS is_gene,
    CASE WHEN kk % 25 = 7 THEN 'unlisted' WHEN kk % 10 < 6 THEN 'g' || (dom * 5 + kk % 5) ELSE 'g' || (kk % 20) END AS gene FROM raw2),
sig AS (SELECT 'g' || g AS gene, CAST(k AS INTEGER) AS k, 'type' || k AS cell_type,
    (CASE WHEN g // 5 = k THEN 0.6e0 / 5 ELSE 0 END) + 0.4e0 / 20 AS theta FROM range(20) a(g), range(4) b(k)),
p AS (SELECT tid, x, y, z, gene FROM t WHERE qv >= 20 AND is_gene AND gene IN (SELECT gene FROM sig))"""


def query(name: str, sql: str | None = None, with_: str = ""):
    """Registers a query, with its SQL on the tables ``t``, ``sig`` and ``p``."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {T_SQL}{', ' + with_ if with_ else ''} {sql}"
        return f

    return add


def r6(c) -> F.Column:
    """Rounded to 6 places; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events_transcripts(spark, sf_dir)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.transcripts(raw(spark, sf_dir), tables.block_signatures(spark)).select("tid", "x", "y", "z", "gene")


# --- sources, filters, projections


@query("transcripts", "SELECT tid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, gene, qv, is_gene, dom FROM t")
def _(spark, d):
    return raw(spark, d).select("tid", r6("x_location").alias("x"), r6("y_location").alias("y"), r6("z_location").alias("z"), F.col("feature_name").alias("gene"), "qv", "is_gene", "dom")


@query("filter_quality", "SELECT tid, qv FROM t WHERE qv >= 20")
def _(spark, d):
    return filters.quality(raw(spark, d)).select("tid", "qv")


@query("filter_gene_flag", "SELECT tid, gene FROM t WHERE is_gene")
def _(spark, d):
    return filters.gene_rows(raw(spark, d)).select("tid", F.col("feature_name").alias("gene"))


@query("filter_known_genes", "SELECT tid, gene FROM t WHERE gene IN (SELECT gene FROM sig)")
def _(spark, d):
    return filters.known_genes(raw(spark, d), tables.block_signatures(spark)).select("tid", F.col("feature_name").alias("gene"))


@query("filter_transcripts", "SELECT tid, round(x, 6) AS x, gene FROM p")
def _(spark, d):
    return points(spark, d).select("tid", r6("x").alias("x"), "gene")


@query(
    "filter_counts",
    "SELECT count(*) AS n_rows, count(*) FILTER (qv >= 20) AS n_quality, count(*) FILTER (qv >= 20 AND is_gene) AS n_gene, (SELECT count(*) FROM p) AS n_known FROM t",
)
def _(spark, d):
    return filters.filter_counts(raw(spark, d), tables.block_signatures(spark))


def seen_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the genes that the point table has, floored and scaled."""
    seen = raw(spark, sf_dir).select(F.col("feature_name").alias("gene")).distinct()
    return signatures.prepared(tables.block_signatures(spark).join(seen, "gene", "left_semi"), 0.05)


SEEN_SQL = """seen AS (SELECT * FROM sig WHERE gene IN (SELECT gene FROM t)), fl AS (SELECT gene, k, cell_type, greatest(theta, 0.05e0) AS f FROM seen),
prep AS (SELECT gene, k, cell_type, f / sum(f) OVER (PARTITION BY k) AS theta FROM fl)"""


@query("signature_prepare", "SELECT gene, k, cell_type, round(theta, 6) AS theta, round(ln(theta), 6) AS log_theta FROM prep", SEEN_SQL)
def _(spark, d):
    return seen_signatures(spark, d).select("gene", "k", "cell_type", r6("theta").alias("theta"), r6(F.ln("theta")).alias("log_theta"))


@query(
    "signature_wide",
    "SELECT gene, " + ", ".join(f"round(max(theta) FILTER (k = {k}), 6) AS type{k}" for k in range(4)) + " FROM prep GROUP BY gene", SEEN_SQL,
)
def _(spark, d):
    wide = tables.signatures_wide(seen_signatures(spark, d))
    return wide.select("gene", *[r6(f"type{k}").alias(f"type{k}") for k in range(4)])


@query("signature_long", "SELECT gene, CAST(k AS INTEGER) AS k, cell_type, round(theta, 6) AS theta FROM prep", SEEN_SQL)
def _(spark, d):
    found = tables.signatures_from_wide(tables.signatures_wide(seen_signatures(spark, d)))
    return found.select("gene", "k", "cell_type", r6("theta").alias("theta"))


@query("node_potentials", "SELECT tid, k, round(ln(theta), 6) AS log_theta FROM p JOIN sig USING (gene)")
def _(spark, d):
    return potts.node_potentials(points(spark, d), tables.block_signatures(spark)).select(F.col("node").alias("tid"), F.posexplode("phi").alias("k", "v")).select("tid", "k", r6("v").alias("log_theta"))


SLICE_SQL = """lp AS (SELECT tid, k, ln(theta) AS v FROM p JOIN sig USING (gene)),
mx AS (SELECT tid, max(v) AS m FROM lp GROUP BY tid), ls AS (SELECT tid, m + ln(sum(exp(v - m))) AS lse FROM lp JOIN mx USING (tid) GROUP BY tid, m),
po AS (SELECT tid, k, exp(v - lse) AS q FROM lp JOIN ls USING (tid))"""


@query("log_sum_exp", "SELECT tid, round(lse, 6) AS lse FROM ls", SLICE_SQL)
def _(spark, d):
    return potts.node_potentials(points(spark, d), tables.block_signatures(spark)).select(F.col("node").alias("tid"), r6(log_sum_exp(F.col("phi"))).alias("lse"))


@query("slice_posterior", "SELECT tid, k, round(q, 6) AS q FROM po", SLICE_SQL)
def _(spark, d):
    found = workflows.minimum_slice(points(spark, d), tables.block_signatures(spark))
    return found.select(F.col("node").alias("tid"), F.posexplode("p").alias("k", "q")).select("tid", "k", r6("q").alias("q"))


@query("slice_labels", "SELECT tid, CAST(min(k) AS INTEGER) AS label_k, 'type' || min(k) AS label FROM po JOIN (SELECT tid, max(q) AS m FROM po GROUP BY tid) USING (tid) WHERE q >= m - 1e-12 GROUP BY tid", SLICE_SQL)
def _(spark, d):
    found = workflows.minimum_slice(points(spark, d), tables.block_signatures(spark))
    return workflows.named_labels(found, [f"type{k}" for k in range(4)]).select(F.col("node").alias("tid"), "label_k", "label")


# --- Hilbert order


@query("coordinate_extent", "SELECT round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(min(z), 6) AS min_z, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) AS extent FROM p")
def _(spark, d):
    found = hilbert.extent(points(spark, d), ["x", "y", "z"])
    return found.select(*[r6(c).alias(c) for c in found.columns])


def hilbert_sql(coords: list[str], bits: int) -> str:
    n, top = len(coords), (1 << bits) - 1
    xs = [f"x{i}" for i in range(n)]
    scaled = ", ".join(f"CAST(round(({c} - (SELECT min({c}) FROM p)) / (SELECT greatest({', '.join(f'max({a}) - min({a})' for a in coords)}) FROM p) * {top}) AS BIGINT) AS {x}" for c, x in zip(coords, xs, strict=True))
    cte = [f"h0 AS (SELECT tid, {scaled} FROM p)"]
    # one recursion step a bit: the axes in turn change axis 0 and themselves
    prev = "(SELECT tid, CAST({q} AS BIGINT) AS q, {x} FROM h0)".format(q=1 << (bits - 1), x=", ".join(xs))
    state, steps = list(xs), []
    inner = "SELECT tid, q, " + ", ".join(xs) + " FROM walk WHERE q > 1"
    for i in range(n):
        if i == 0:
            cols = ["CASE WHEN (x0 & q) <> 0 THEN xor(x0, q - 1) ELSE x0 END AS x0"] + xs[1:]
        else:
            on, t = f"(x{i} & q) <> 0", f"(xor(x0, x{i}) & (q - 1))"
            cols = [f"CASE WHEN {on} THEN xor(x0, q - 1) ELSE xor(x0, {t}) END AS x0"] + [
                f"CASE WHEN {on} THEN x{j} ELSE xor(x{j}, {t}) END AS x{j}" if j == i else f"x{j}" for j in range(1, n)
            ]
        inner = f"SELECT tid, q, {', '.join(cols)} FROM ({inner})"
    cte.append(f"walk AS (SELECT * FROM {prev} UNION ALL SELECT tid, q // 2 AS q, {', '.join(xs)} FROM ({inner}))")
    gray, expr = [], "x0"
    for i in range(n):
        expr = "x0" if i == 0 else f"xor({expr}, x{i})"
        gray.append(f"{expr} AS g{i}")
    cte.append(f"gray AS (SELECT tid, {', '.join(gray)} FROM walk WHERE q = 1)")
    flip = f"list_reduce(list_transform(range(1, {bits}), lambda j: CASE WHEN ((g{n - 1} >> CAST(j AS INTEGER)) & 1) = 1 THEN (CAST(1 AS BIGINT) << CAST(j AS INTEGER)) - 1 ELSE 0 END), lambda a, b: xor(a, b))"
    cte.append(f"flip AS (SELECT tid, {', '.join(f'xor(g{i}, {flip}) AS f{i}' for i in range(n))} FROM gray)")
    terms = " + ".join(f"(((f{i} >> {b}) & 1) << {b * n + (n - 1 - i)})" for b in range(bits) for i in range(n))
    cte.append(f"hil AS (SELECT tid, {terms} AS hilbert FROM flip)")
    return ", ".join(cte)


@query("hilbert_2d", "SELECT tid, hilbert FROM hil", hilbert_sql(["x", "y"], LEVEL))
def _(spark, d):
    return hilbert.hilbert_index(points(spark, d), ["x", "y"], LEVEL).select("tid", "hilbert")


@query("hilbert_3d", "SELECT tid, hilbert FROM hil", hilbert_sql(["x", "y", "z"], LEVEL))
def _(spark, d):
    return hilbert.hilbert_index(points(spark, d), ["x", "y", "z"], LEVEL).select("tid", "hilbert")


_axes = ", ".join(f"CAST(round(({c} - (SELECT min({c}) FROM p)) / (SELECT greatest(max(x) - min(x), max(y) - min(y)) FROM p) * {(1 << LEVEL) - 1}) AS BIGINT) AS {c}_scaled" for c in "xy")


@query(
    "hilbert_result",
    f"SELECT tid, x_scaled, y_scaled, CAST(hilbert AS DOUBLE) AS hilbert_double, (SELECT round(min(x), 6) FROM p) AS min_x, (SELECT round(min(y), 6) FROM p) AS min_y, "
    f"(SELECT round(greatest(max(x) - min(x), max(y) - min(y)), 6) FROM p) AS extent, CAST({LEVEL} AS INTEGER) AS bits FROM hil JOIN (SELECT tid, {_axes} FROM p) USING (tid)",
    hilbert_sql(["x", "y"], LEVEL),
)
def _(spark, d):
    found = hilbert.hilbert_result(points(spark, d), ["x", "y"], LEVEL)
    made = [r6(F.lit(found.mins["x"])).alias("min_x"), r6(F.lit(found.mins["y"])).alias("min_y"), r6(F.lit(found.extent)).alias("extent"), F.lit(found.bits).alias("bits")]
    return found.rows.select("tid", "x_scaled", "y_scaled", "hilbert_double", *made)


@query("hilbert_order", 'SELECT tid, hilbert, row_number() OVER (ORDER BY hilbert, tid) AS "index" FROM hil', hilbert_sql(["x", "y"], LEVEL))
def _(spark, d):
    return hilbert.hilbert_order(points(spark, d), ["x", "y"], LEVEL).select("tid", "hilbert", "index")


# --- barycentric bases and the lattice

S3 = math.sqrt(3)
TRI_SQL = f"""tv AS (SELECT *, 2 * y / ({S3!r}e0 * {EDGE}e0) AS v FROM p), tu AS (SELECT *, x / {EDGE}e0 - v / 2 AS u FROM tv),
tf AS (SELECT tid, gene, CAST(floor(u) AS BIGINT) AS i, CAST(floor(v) AS BIGINT) AS j, u - floor(u) AS r, v - floor(v) AS s FROM tu),
vert AS (SELECT tid, gene, i, j, 1 - r - s AS w FROM tf WHERE r + s <= 1 UNION ALL SELECT tid, gene, i + 1, j, r FROM tf WHERE r + s <= 1 UNION ALL SELECT tid, gene, i, j + 1, s FROM tf WHERE r + s <= 1
UNION ALL SELECT tid, gene, i + 1, j + 1, r + s - 1 FROM tf WHERE r + s > 1 UNION ALL SELECT tid, gene, i, j + 1, 1 - r FROM tf WHERE r + s > 1 UNION ALL SELECT tid, gene, i + 1, j, 1 - s FROM tf WHERE r + s > 1),
pts AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS basis_id FROM (SELECT DISTINCT i, j FROM vert WHERE w > 1e-9))"""

_axis = "CAST(2 * round(q{0} / 2) AS BIGINT)"
BCC_SQL = f"""bq AS (SELECT *, x / ({EDGE}e0 / 2) AS q0, y / ({EDGE}e0 / 2) AS q1, z / ({EDGE}e0 / 2) AS q2 FROM p),
be AS (SELECT *, {_axis.format(0)} AS e0, {_axis.format(1)} AS e1, {_axis.format(2)} AS e2 FROM bq),
ba AS (SELECT *, CASE WHEN q0 >= e0 THEN 1 ELSE -1 END AS s0, CASE WHEN q1 >= e1 THEN 1 ELSE -1 END AS s1, CASE WHEN q2 >= e2 THEN 1 ELSE -1 END AS s2, abs(q0 - e0) AS a0, abs(q1 - e1) AS a1, abs(q2 - e2) AS a2 FROM be),
bm AS (SELECT *, greatest(a0, a1, a2) AS hi, least(a0, a1, a2) AS lo, a0 + a1 + a2 - greatest(a0, a1, a2) - least(a0, a1, a2) AS mid,
  CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS fst, CASE WHEN a2 <= a0 AND a2 <= a1 THEN 2 WHEN a1 <= a0 THEN 1 ELSE 0 END AS lst FROM ba),
vert AS (SELECT tid, gene, e0 AS i, e1 AS j, e2 AS k, 1 - (hi + mid) / 2 AS w FROM bm
UNION ALL SELECT tid, gene, e0 + CASE WHEN fst = 0 THEN 2 * s0 ELSE 0 END, e1 + CASE WHEN fst = 1 THEN 2 * s1 ELSE 0 END, e2 + CASE WHEN fst = 2 THEN 2 * s2 ELSE 0 END, (hi - mid) / 2 FROM bm
UNION ALL SELECT tid, gene, e0 + s0, e1 + s1, e2 + s2, (mid + lo) / 2 FROM bm
UNION ALL SELECT tid, gene, e0 + s0 - CASE WHEN lst = 0 THEN 2 * s0 ELSE 0 END, e1 + s1 - CASE WHEN lst = 1 THEN 2 * s1 ELSE 0 END, e2 + s2 - CASE WHEN lst = 2 THEN 2 * s2 ELSE 0 END, (mid - lo) / 2 FROM bm),
pts AS (SELECT i, j, k, row_number() OVER (ORDER BY i, j, k) - 1 AS basis_id FROM (SELECT DISTINCT i, j, k FROM vert WHERE w > 1e-9))"""


def vertices(spark: SparkSession, d: str, basis: str) -> DataFrame:
    """Vertices of positive weight: which zero-weight vertex a point on a face gets is a matter of rounding."""
    return lattice.barycentric(points(spark, d), basis, EDGE).where("w > 1e-9")


def _vertex_query(basis: str) -> Callable:
    return lambda spark, d: vertices(spark, d, basis).select("tid", *lattice.lattice_keys(basis), r6("w").alias("w"))


query("tri_barycentric", "SELECT tid, i, j, round(w, 6) AS w FROM vert WHERE w > 1e-9", TRI_SQL)(_vertex_query("tri"))
query("bcc_barycentric", "SELECT tid, i, j, k, round(w, 6) AS w FROM vert WHERE w > 1e-9", BCC_SQL)(_vertex_query("bcc"))


def _points_query(basis: str) -> Callable:
    def run(spark, d):
        found = lattice.basis_points(vertices(spark, d, basis), basis, EDGE)
        return found.select("basis_id", *lattice.lattice_keys(basis), *[r6(c).alias(c) for c in ("px", "py", "pz") if c in found.columns])

    return run


query("tri_points", f"SELECT basis_id, i, j, round({EDGE}e0 * (i + j / 2), 6) AS px, round({EDGE}e0 * {S3!r}e0 / 2 * j, 6) AS py FROM pts", TRI_SQL)(_points_query("tri"))
query("bcc_points", f"SELECT basis_id, i, j, k, round({EDGE}e0 / 2 * i, 6) AS px, round({EDGE}e0 / 2 * j, 6) AS py, round({EDGE}e0 / 2 * k, 6) AS pz FROM pts", BCC_SQL)(_points_query("bcc"))


def _design_query(basis: str) -> Callable:
    def run(spark, d):
        v = vertices(spark, d, basis)
        return lattice.design(v, lattice.basis_points(v, basis, EDGE), basis).select("tid", "basis_id", r6("w").alias("w"))

    return run


query("tri_design", "SELECT tid, basis_id, round(w, 6) AS w FROM vert JOIN pts USING (i, j) WHERE w > 1e-9", TRI_SQL)(_design_query("tri"))
query("bcc_design", "SELECT tid, basis_id, round(w, 6) AS w FROM vert JOIN pts USING (i, j, k) WHERE w > 1e-9", BCC_SQL)(_design_query("bcc"))


def _edges_query(basis: str) -> Callable:
    return lambda spark, d: lattice.lattice_edges(lattice.basis_points(vertices(spark, d, basis), basis, EDGE), basis, EDGE).select("m1", "m2", r6("distance").alias("distance"))


TRI_EDGES_SQL = f"le AS (SELECT least(a.basis_id, b.basis_id) AS m1, greatest(a.basis_id, b.basis_id) AS m2, {EDGE}e0 AS distance FROM pts a JOIN pts b ON (b.i = a.i + 1 AND b.j IN (a.j, a.j - 1)) OR (b.i = a.i AND b.j = a.j + 1))"
BCC_EDGES_SQL = f"""off(a, b, c, dd) AS (VALUES (2, 0, 0, 1e0), (0, 2, 0, 1e0), (0, 0, 2, 1e0), (1, 1, 1, {S3 / 2!r}e0), (1, 1, -1, {S3 / 2!r}e0), (1, -1, 1, {S3 / 2!r}e0), (1, -1, -1, {S3 / 2!r}e0)),
le AS (SELECT least(p1.basis_id, p2.basis_id) AS m1, greatest(p1.basis_id, p2.basis_id) AS m2, dd * {EDGE}e0 AS distance FROM pts p1, off, pts p2 WHERE p2.i = p1.i + a AND p2.j = p1.j + b AND p2.k = p1.k + c)"""
query("tri_edges", "SELECT m1, m2, round(distance, 6) AS distance FROM le", f"{TRI_SQL}, {TRI_EDGES_SQL}")(_edges_query("tri"))
query("bcc_edges", "SELECT m1, m2, round(distance, 6) AS distance FROM le", f"{BCC_SQL}, {BCC_EDGES_SQL}")(_edges_query("bcc"))


#: Lattice points by first appearance, slot by slot in the order of tid, and the edges that go up in these ids.
TRI_SEEN_SQL = f"""{TRI_SQL}, sl AS (SELECT tid, i, j, CASE WHEN r + s <= 1 THEN 0 ELSE 1 END AS up FROM tf),
sv AS (SELECT tid, 0 AS slot, i + up AS i, j + up AS j FROM sl UNION ALL SELECT tid, 1, CASE WHEN up = 0 THEN i + 1 ELSE i END, j + up FROM sl UNION ALL SELECT tid, 2, CASE WHEN up = 0 THEN i ELSE i + 1 END, CASE WHEN up = 0 THEN j + 1 ELSE j END FROM sl),
fs AS (SELECT i, j, min(slot * 1000000000000 + tid) AS f FROM sv GROUP BY i, j), fp AS (SELECT i, j, row_number() OVER (ORDER BY f) - 1 AS basis_id FROM fs)"""


def _seen(spark: SparkSession, d: str, basis: str) -> DataFrame:
    return lattice.basis_points(lattice.barycentric(points(spark, d), basis, EDGE, first_fit=True), basis, EDGE, by_appearance=True)


@query("tri_points_by_appearance", "SELECT basis_id, i, j FROM fp", TRI_SEEN_SQL)
def _(spark, d):
    return _seen(spark, d, "tri").select("basis_id", "i", "j")


@query("tri_edges_by_appearance", "SELECT a.basis_id AS m1, b.basis_id AS m2 FROM fp a JOIN fp b ON (b.i = a.i + 1 AND b.j IN (a.j, a.j - 1)) OR (b.i = a.i AND b.j = a.j + 1) WHERE a.basis_id < b.basis_id", TRI_SEEN_SQL)
def _(spark, d):
    return lattice.lattice_edges(_seen(spark, d, "tri"), "tri", EDGE, every=False).select("m1", "m2")


@query("bcc_edges_by_appearance")
def _(spark, d):
    return lattice.lattice_edges(_seen(spark, d, "bcc"), "bcc", EDGE, every=False).select("m1", "m2", r6("distance").alias("distance"))


# --- neighbours and graphs

KNN_SQL = f"""cel AS (SELECT *, CAST(floor(x / {RADIUS}e0) AS BIGINT) AS gx, CAST(floor(y / {RADIUS}e0) AS BIGINT) AS gy, CAST(floor(z / {RADIUS}e0) AS BIGINT) AS gz FROM p),
pr AS (SELECT tid, x, y, z, gx + dx AS gx, gy + dy AS gy, gz + dz AS gz FROM cel, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz)),
pa AS (SELECT pr.tid AS src, cel.tid AS dst, sqrt((pr.x - cel.x) * (pr.x - cel.x) + (pr.y - cel.y) * (pr.y - cel.y) + (pr.z - cel.z) * (pr.z - cel.z)) AS dist FROM pr JOIN cel USING (gx, gy, gz) WHERE pr.tid <> cel.tid),
near AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rnk FROM pa WHERE dist <= {RADIUS}e0),
knn AS MATERIALIZED (SELECT src, dst, dist, rnk FROM near WHERE rnk <= {NEIGHBOURS}), w AS (SELECT ln({RATIO}e0) AS wt),
dir AS (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn), und AS (SELECT src AS u, dst AS v FROM dir WHERE src < dst)"""


def near(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn_edges(tables.cut(points(spark, d)), NEIGHBOURS, RADIUS)


@query("radius_pairs", f"SELECT src, dst, round(dist, 6) AS dist FROM pa WHERE dist <= {RADIUS}e0", KNN_SQL)
def _(spark, d):
    return knn.radius_pairs(points(spark, d), RADIUS, shown=r6("dist"))


@query("knn_edges", 'SELECT src, dst, round(dist, 6) AS dist, rnk AS "rank" FROM knn', KNN_SQL)
def _(spark, d):
    return near(spark, d).select("src", "dst", r6("dist").alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@query("candidate_edges", "SELECT count(*) * 2 AS n_candidates FROM knn", KNN_SQL)
def _(spark, d):
    return near(spark, d).agg((F.count("*") * 2).alias("n_candidates"))


def weighted(pts: DataFrame) -> DataFrame:
    return graph.directed(graph.with_weight(knn.knn_edges(pts, NEIGHBOURS, RADIUS), math.log(RATIO)), symmetric=True, drop_diagonal=True)


def nodes(pts: DataFrame) -> DataFrame:
    return pts.select(F.col("tid").alias("node"))


@query("graph_symmetric", "SELECT src, dst, round(wt, 6) AS w FROM dir, w", KNN_SQL)
def _(spark, d):
    return weighted(tables.cut(points(spark, d))).select("src", "dst", r6("w").alias("w"))


@query("graph_one_way", "SELECT a.src, a.dst FROM knn a LEFT JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE b.src IS NULL", KNN_SQL)
def _(spark, d):
    found = graph.reverse_edges(graph.directed(graph.with_weight(near(spark, d), 1.0)), check_reverse=False)
    return found.where("rev_id is null").select("src", "dst")


POS_SQL = KNN_SQL + ", pos AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM dir)"


@query("graph_reverse", "SELECT a.edge_id, a.src, a.dst, b.edge_id AS rev_id FROM pos a JOIN pos b ON a.src = b.dst AND a.dst = b.src", POS_SQL)
def _(spark, d):
    return graph.reverse_edges(weighted(tables.cut(points(spark, d)))).select("edge_id", "src", "dst", "rev_id")


@query("graph_degree", "SELECT tid AS node, count(dst) AS degree FROM p LEFT JOIN dir ON src = tid GROUP BY tid", KNN_SQL)
def _(spark, d):
    pts = tables.cut(points(spark, d))
    return graph.degrees(weighted(pts), nodes(pts))


@query("graph_row_pointers", "SELECT node, CAST(coalesce(sum(deg) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT tid AS node, count(dst) AS deg FROM p LEFT JOIN dir ON src = tid GROUP BY tid)", KNN_SQL)
def _(spark, d):
    pts = tables.cut(points(spark, d))
    return graph.row_pointers(weighted(pts), nodes(pts))


@query(
    "graph_csr", "SELECT node, start FROM (SELECT node, CAST(coalesce(sum(deg) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start "
    "FROM (SELECT tid AS node, count(dst) AS deg FROM p LEFT JOIN dir ON src = tid GROUP BY tid)) UNION ALL SELECT (SELECT max(tid) + 1 FROM p), (SELECT count(*) FROM dir)", KNN_SQL,
)
def _(spark, d):
    pts = tables.cut(points(spark, d))
    found = graph.csr(tables.cut(weighted(pts)), nodes(pts))
    return found.pointers.select("node", "start")


@query("graph_from_matrix", "SELECT CAST(o_custkey AS BIGINT) AS src, CAST(o_custkey % 100 AS BIGINT) AS dst, count(*) AS n FROM orders WHERE o_custkey <> o_custkey % 100 GROUP BY 1, 2")
def _(spark, d):
    o = tables.read_table(spark, d, "orders")
    cells = o.select(F.col("o_custkey").alias("row"), (F.col("o_custkey") % 100).alias("col")).groupBy("row", "col").agg(F.count("*").alias("weight"))
    return graph.directed(tables.coo_matrix(cells), drop_diagonal=True).select("src", "dst", F.col("w").cast("bigint").alias("n"))


# --- belief propagation


def lbp_sql(sweeps: int, damping: float = 1.0) -> str:
    """Long-form sweeps: one row a directed edge and type."""
    cte = [KNN_SQL, "phi AS (SELECT tid AS node, k, ln(theta) AS v FROM p JOIN sig USING (gene))", "m0 AS (SELECT src, dst, k, 0e0 AS m FROM dir, range(4) a(k))", "h0 AS (SELECT * FROM phi)"]
    for t in range(1, sweeps + 1):
        p = t - 1
        cte += [
            f"c{t} AS MATERIALIZED (SELECT e.src, e.dst, e.k, e.m AS old, h.v - r.m AS c FROM m{p} e JOIN h{p} h ON h.node = e.src AND h.k = e.k JOIN m{p} r ON r.src = e.dst AND r.dst = e.src AND r.k = e.k)",
            f"s{t} AS (SELECT src, dst, max(c) AS mx, max(c) + ln(sum(exp(c - cm))) AS lse FROM (SELECT *, max(c) OVER (PARTITION BY src, dst) AS cm FROM c{t}) GROUP BY src, dst)",
            f"v{t} AS (SELECT src, dst, k, old, ln(exp(lse) + ({RATIO}e0 - 1) * exp(c)) AS v FROM c{t} JOIN s{t} USING (src, dst))",
            f"n{t} AS (SELECT src, dst, ln(sum(exp(v))) AS z FROM v{t} GROUP BY src, dst)",
            f"m{t} AS MATERIALIZED (SELECT src, dst, k, (1 - {damping}e0) * old + {damping}e0 * (v - z) AS m, abs((1 - {damping}e0) * old + {damping}e0 * (v - z) - old) AS delta FROM v{t} JOIN n{t} USING (src, dst))",
            f"h{t} AS MATERIALIZED (SELECT node, phi.k, v + coalesce(sum(m), 0) AS v FROM phi LEFT JOIN m{t} ON m{t}.dst = node AND m{t}.k = phi.k GROUP BY node, phi.k, v)",
        ]
    t = sweeps
    cte += [f"marg AS (SELECT node, k, exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY node) AS p FROM (SELECT *, max(v) OVER (PARTITION BY node) AS mx FROM h{t}))"]
    return ", ".join(cte)


def beliefs(spark: SparkSession, d: str, sweeps: int, damping: float = 1.0, radius: float = RADIUS, **options) -> potts.Beliefs:
    pts = tables.cut(points(spark, d))
    edges = tables.stored(workflows.neighbour_graph(pts, NEIGHBOURS, radius, RATIO))
    phi = tables.stored(potts.node_potentials(workflows.placed(pts), tables.block_signatures(spark)))
    return potts.belief_propagation(edges, phi, 4, sweeps, damping, **({"tol": 0.0} | options))


def _marginals(b: potts.Beliefs) -> DataFrame:
    return b.marginals.select("node", F.posexplode("p").alias("k", "p")).select("node", "k", r6("p").alias("p"))


for _n, _damp in ((1, 1.0), (2, 0.5), (3, 1.0)):
    query(f"lbp_sweeps_{_n}", "SELECT node, CAST(k AS INTEGER) AS k, round(p, 6) AS p FROM marg", lbp_sql(_n, _damp))(
        lambda spark, d, n=_n, damp=_damp: _marginals(beliefs(spark, d, n, damp))
    )


@query("matrix_beliefs", "SELECT node, CAST(k AS INTEGER) AS k, round(p, 6) AS p FROM marg", lbp_sql(2, 0.5))
def _(spark, d):
    pts = tables.cut(points(spark, d))
    cells = weighted(pts).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("weight"))
    n = pts.agg(F.max("tid")).first()[0] + 1
    return _marginals(workflows.matrix_beliefs(cells, n, n, potts.node_potentials(workflows.placed(pts), tables.block_signatures(spark)), 4, max_iter=2, damping=0.5, tol=0.0))


@query("lbp_change", "SELECT CAST(2 AS BIGINT) AS iterations, round(max(delta), 6) AS max_delta, round(avg(delta), 6) AS mean_delta FROM m2", lbp_sql(2))
def _(spark, d):
    b = beliefs(spark, d, 2)
    found = spark.createDataFrame([(b.iterations, b.max_delta, b.mean_delta)], "iterations bigint, max_delta double, mean_delta double")
    return found.select("iterations", r6("max_delta").alias("max_delta"), r6("mean_delta").alias("mean_delta"))


@query(
    "lbp_history", "SELECT CAST(1 AS INTEGER) AS iteration, round(max(delta), 6) AS max_delta, round(avg(delta), 6) AS mean_delta FROM m1 "
    "UNION ALL SELECT 2, round(max(delta), 6), round(avg(delta), 6) FROM m2", lbp_sql(2),
)
def _(spark, d):
    return potts.history_table(beliefs(spark, d, 2)).select("iteration", r6("max_delta").alias("max_delta"), r6("mean_delta").alias("mean_delta"))


@query("lbp_in_place")
def _(spark, d):
    return _marginals(beliefs(spark, d, 50, schedule="in_place", tol=1e-2))


@query("lbp_async")
def _(spark, d):
    return _marginals(beliefs(spark, d, 50, schedule="async", tol=1e-2))


LABEL_SQL = "SELECT node AS tid, CAST(arg_max(k, p) AS INTEGER) AS label_k, 'type' || arg_max(k, p) AS label FROM marg GROUP BY node"


@query("crf_labels", LABEL_SQL, lbp_sql(3))
def _(spark, d):
    found = workflows.run_crf(raw(spark, d), tables.block_signatures(spark), tol=0.0, max_iter=3, with_order=False)
    return found.labels.select("tid", "label_k", "label")


@query("crf_default")
def _(spark, d):
    found = workflows.run_crf(raw(spark, d), tables.block_signatures(spark))
    return found.labels.select("tid", "hilbert", "index", "gene", "label")


# --- the field


def fixed_w(n_basis: int, types: int = 4) -> np.ndarray:
    return np.sin(1.7 * np.arange(n_basis)[:, None] + np.arange(types)[None, :])


def problem(spark: SparkSession, d: str, basis: str) -> workflows.FieldProblem:
    return workflows.field_problem(tables.cut(points(spark, d)), tables.block_signatures(spark), basis, EDGE)


def basis_sql(basis: str) -> str:
    base = TRI_SQL if basis == "tri" else BCC_SQL
    # the full basis keeps vertices of weight 0; positions of this fixture touch none alone
    base = base.replace(" WHERE w > 1e-9", "")
    edges = TRI_EDGES_SQL if basis == "tri" else BCC_EDGES_SQL
    keys = "i, j" if basis == "tri" else "i, j, k"
    return f"""{base}, {edges}, wm AS (SELECT basis_id AS m, t AS t, sin(1.7e0 * basis_id + t) AS w FROM pts, range(4) a(t)),
lg AS (SELECT tid, t, sum(vert.w * wm.w) AS f FROM vert JOIN pts USING ({keys}) JOIN wm ON wm.m = pts.basis_id GROUP BY tid, t),
jn AS (SELECT lg.tid, lg.t, f, f + ln(theta) AS g FROM lg JOIN p ON p.tid = lg.tid JOIN sig ON sig.gene = p.gene AND sig.k = lg.t),
ps AS (SELECT tid, t, f, exp(f) / sum(exp(f)) OVER (PARTITION BY tid) AS prior, exp(g) / sum(exp(g)) OVER (PARTITION BY tid) AS post FROM jn)"""


def _predict_query(basis: str) -> Callable:
    def run(spark, d):
        pr = problem(spark, d, basis)
        found = fields.predict(pr.points, fixed_w(pr.n_basis), pr.log_theta)
        long = found.select("tid", F.posexplode(F.arrays_zip("logits", "prior", "posterior")).alias("k", "v"))
        return long.select("tid", "k", r6("v.logits").alias("logit"), r6("v.prior").alias("prior"), r6("v.posterior").alias("posterior"))

    return run


for _basis in ("tri", "bcc"):
    query(f"field_predict_{_basis}", "SELECT tid, CAST(t AS INTEGER) AS k, round(f, 6) AS logit, round(prior, 6) AS prior, round(post, 6) AS posterior FROM ps", basis_sql(_basis))(_predict_query(_basis))

SLOPES = {
    "quadratic": "r * r / 2", "huber": "CASE WHEN abs(r) <= 0.1 THEN r * r / 2 ELSE 0.1e0 * (abs(r) - 0.05e0) END", "bounded": "0.04e0 * (1 - exp(-r * r / 0.08e0))",
}
IMPURITIES = {"none": "0e0", "entropy": "-sum(q * ln(q))", "gini": "1 - sum(q * q)"}


def _penalty(reg: str, pur: str) -> fields.Penalty:
    return fields.Penalty(0.7, reg, 0.1, 0.2, pur, 0.3)


def objective_sql(basis: str, reg: str, pur: str) -> str:
    return f"""nll AS (SELECT avg(ln(sf) - ln(sg)) AS v FROM (SELECT tid, sum(exp(f)) AS sf, sum(exp(g)) AS sg FROM jn GROUP BY tid)),
sm AS (SELECT sum({SLOPES[reg]}) / (SELECT count(*) FROM le) AS v FROM (SELECT (a.w - b.w) / distance AS r FROM le JOIN wm a ON a.m = m1 JOIN wm b ON b.m = m2 AND b.t = a.t)),
im AS (SELECT avg(h) AS v FROM (SELECT m, {IMPURITIES[pur]} AS h FROM (SELECT m, exp(w) / sum(exp(w)) OVER (PARTITION BY m) AS q FROM wm) GROUP BY m))"""


def _objective_query(basis: str, pairs: list[tuple[str, str]]) -> Callable:
    def run(spark, d):
        pr = problem(spark, d, basis)
        w = fixed_w(pr.n_basis)
        rows = [(reg, pur, float(fields.objective(pr.points, w, pr.log_theta, pr.edges, _penalty(reg, pur))[0])) for reg, pur in pairs]
        return spark.createDataFrame(rows, "regularization string, purity string, value double").withColumn("value", r6("value"))

    return run


for _basis, _pairs in (("tri", [("quadratic", "none"), ("huber", "entropy"), ("bounded", "gini")]), ("bcc", [("quadratic", "gini"), ("huber", "none"), ("bounded", "entropy")])):
    _selects = []
    for _r, _p in _pairs:
        _selects.append(f"SELECT '{_r}' AS regularization, '{_p}' AS purity, round((SELECT v FROM nll) + 0.7e0 * (SELECT v FROM sm_{_r}) + 0.3e0 * (SELECT v FROM im_{_p}), 6) AS value")
    _with = basis_sql(_basis)
    for _n, (_r, _p) in enumerate(_pairs):
        _parts = objective_sql(_basis, _r, _p).replace("sm AS", f"sm_{_r} AS").replace("im AS", f"im_{_p} AS")
        _with += ", " + (_parts if _n == 0 else _parts[_parts.index("sm_"):])
    query(f"field_objective_{_basis}", " UNION ALL ".join(_selects), _with)(_objective_query(_basis, _pairs))

GRADIENT_SQL = """dq AS (SELECT tid, t, prior - post AS df FROM ps),
gl AS (SELECT pts.basis_id AS m, t, sum(vert.w * df) / (SELECT count(DISTINCT tid) FROM p) AS g FROM vert JOIN pts USING (i, j, k) JOIN dq USING (tid) GROUP BY 1, 2),
sl AS (SELECT m1, m2, a.t, (a.w - b.w) / distance / distance * 0.7e0 / (SELECT count(*) FROM le) AS st FROM le JOIN wm a ON a.m = m1 JOIN wm b ON b.m = m2 AND b.t = a.t),
gs AS (SELECT m, t, sum(st) AS g FROM (SELECT m1 AS m, t, st FROM sl UNION ALL SELECT m2, t, -st FROM sl) GROUP BY m, t),
ga AS (SELECT wm.m, wm.t, coalesce(gl.g, 0) + coalesce(gs.g, 0) AS g FROM wm LEFT JOIN gl USING (m, t) LEFT JOIN gs USING (m, t))"""


#: Lattice points of a block in the queries of the blocked field, so that small tables have several.
SPAN = 50


def blocked(spark: SparkSession, d: str, basis: str) -> tuple[workflows.FieldProblem, DataFrame]:
    """The problem in blocks and the fixed coefficients in blocks."""
    pr = workflows.field_problem(tables.cut(points(spark, d)), tables.block_signatures(spark), basis, EDGE, blocked=True, span=SPAN)
    w = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.sin(1.7 * F.col("basis_id") + k))
    return pr, field_blocks.coefficient_blocks(pr.basis.select("basis_id", w.alias("w")), pr.blocks)


@query("field_gradient_bcc", "SELECT m AS basis_id, CAST(t AS INTEGER) AS k, round(g - avg(g) OVER (PARTITION BY m), 6) + 0e0 AS gradient FROM ga", basis_sql("bcc") + ", " + GRADIENT_SQL)
def _(spark, d):
    pr, w = blocked(spark, d, "bcc")
    found = field_blocks.objective_blocks(pr.blocks, w, pr.log_theta, fields.Penalty(0.7, "quadratic"))
    rows = field_blocks.coefficient_rows(found.select("block", F.col("grad").alias("w")), pr.blocks)
    return rows.select("basis_id", F.posexplode("w").alias("k", "gradient")).select("basis_id", "k", r6("gradient").alias("gradient"))


def _halo_predict(basis: str) -> Callable:
    def run(spark, d):
        pr, w = blocked(spark, d, basis)
        long = field_blocks.predict_blocks(pr.blocks, w, pr.log_theta).select("tid", F.posexplode(F.arrays_zip("logits", "prior", "posterior")).alias("k", "v"))
        return long.select("tid", "k", r6("v.logits").alias("logit"), r6("v.prior").alias("prior"), r6("v.posterior").alias("posterior"))

    return run


for _basis in ("tri", "bcc"):
    query(f"halo_predict_{_basis}", "SELECT tid, CAST(t AS INTEGER) AS k, round(f, 6) AS logit, round(prior, 6) AS prior, round(post, 6) AS posterior FROM ps", basis_sql(_basis))(_halo_predict(_basis))

#: Each regularization and each purity term alone, summed up from the blocks.
TERMS = [("quadratic", "none"), ("huber", "none"), ("bounded", "none"), ("quadratic", "entropy"), ("quadratic", "gini")]
_terms_sql = basis_sql("bcc") + ", rr AS (SELECT (a.w - b.w) / distance AS r FROM le JOIN wm a ON a.m = m1 JOIN wm b ON b.m = m2 AND b.t = a.t), n AS (SELECT count(*) AS n FROM le), " + ", ".join(
    f"im_{k} AS (SELECT avg(h) AS v FROM (SELECT m, {v} AS h FROM (SELECT m, exp(w) / sum(exp(w)) OVER (PARTITION BY m) AS q FROM wm) GROUP BY m))" for k, v in IMPURITIES.items()
)


@query(
    "lattice_penalties", " UNION ALL ".join(f"SELECT '{r}' AS regularization, '{p}' AS purity, round(0.7e0 * (SELECT sum({SLOPES[r]}) FROM rr) / (SELECT n FROM n) + 0.3e0 * (SELECT v FROM im_{p}), 6) AS value" for r, p in TERMS), _terms_sql,
)
def _(spark, d):
    pr, w = blocked(spark, d, "bcc")
    w = tables.cut(w)
    found = [
        field_blocks.objective_blocks(pr.blocks, w, pr.log_theta, _penalty(r, p), ("smoothness",)).agg(F.lit(r).alias("regularization"), F.lit(p).alias("purity"), r6(F.sum("value")).alias("value"))
        for r, p in TERMS
    ]
    return functools.reduce(DataFrame.unionByName, found)


@query("centered_coefficients", "SELECT m AS basis_id, CAST(t AS INTEGER) AS k, round(w - avg(w) OVER (PARTITION BY m), 6) AS w FROM wm", basis_sql("tri"))
def _(spark, d):
    pts = lattice.basis_points(lattice.barycentric(points(spark, d), "tri", EDGE), "tri", EDGE)
    w = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.sin(1.7 * F.col("basis_id") + k))
    return pts.select("basis_id", F.posexplode(centered(w)).alias("k", "w")).select("basis_id", "k", r6("w").alias("w"))


def _ended(fit: fields.Fit, name: str) -> list[F.Column]:
    """How a fit ended, as columns."""
    return [F.lit(fit.status).alias(f"{name}_status"), F.lit(fit.iterations).alias(f"{name}_iterations")]


@query("basis_labels")
def _(spark, d):
    found = workflows.spatial_basis(raw(spark, d), tables.block_signatures(spark), EDGE)
    return found.labels.select("tid", "gene", "label_k", "label", *_ended(found.fit, "fit"))


@query("basis_refined_signatures")
def _(spark, d):
    found = workflows.spatial_basis(raw(spark, d), tables.block_signatures(spark), EDGE, "tri", refine_signatures=True)
    first, last = found.fits
    return found.signatures.select("gene", "k", "cell_type", r6("theta").alias("theta"), *_ended(first, "fit"), *_ended(last, "refit"))


# --- refinement

REFINE_SQL = SLICE_SQL + """, cn AS (SELECT gene, k, sum(CASE WHEN q >= 0.2e0 THEN q ELSE 0 END) AS n FROM po JOIN p USING (tid) GROUP BY gene, k),
rf AS (SELECT gene, k, cell_type, theta, coalesce(n, 0e0) AS n FROM sig LEFT JOIN cn USING (gene, k)),
up AS (SELECT gene, k, cell_type, n, theta AS before, greatest(0.75e0 * theta + 0.25e0 * (n + 20 * theta) / (sum(n) OVER (PARTITION BY k) + 20), 1e-12) AS u FROM rf),
nu AS (SELECT gene, k, cell_type, n, before, u / sum(u) OVER (PARTITION BY k) AS theta FROM up)"""


def update(spark: SparkSession, d: str) -> DataFrame:
    sig, pts = tables.block_signatures(spark), points(spark, d)
    q = workflows.minimum_slice(pts, sig).join(pts.select(F.col("tid").alias("node"), "gene"), "node").select("gene", "p")
    return signatures.refined(signatures.weighted_counts(signatures.posterior_long(q, "p"), 0.2), sig, sig, 20.0)


@query("signature_counts", "SELECT gene, CAST(k AS INTEGER) AS k, round(n, 4) AS n FROM cn", REFINE_SQL)
def _(spark, d):
    sig, pts = tables.block_signatures(spark), points(spark, d)
    q = workflows.minimum_slice(pts, sig).join(pts.select(F.col("tid").alias("node"), "gene"), "node").select("gene", "p")
    return signatures.weighted_counts(signatures.posterior_long(q, "p"), 0.2).select("gene", "k", F.round("n", 4).alias("n"))


@query("signature_update", "SELECT gene, CAST(k AS INTEGER) AS k, cell_type, round(theta, 6) AS theta FROM nu", REFINE_SQL)
def _(spark, d):
    return update(spark, d).select("gene", "k", "cell_type", r6("theta").alias("theta"))


@query("signature_update_summary", "SELECT CAST(k AS INTEGER) AS k, round(sum(n), 4) AS effective_count, round(max(abs(theta - before)), 6) AS max_abs_change FROM nu GROUP BY k", REFINE_SQL)
def _(spark, d):
    return signatures.update_summary(update(spark, d)).select("k", F.round("effective_count", 4).alias("effective_count"), r6("max_abs_change").alias("max_abs_change"))


# --- profiling


@query("lbp_memory_estimate", "SELECT n AS n_nodes, e AS n_edges, round((8e0 * e * 4 + 12e0 * n * 4) / 1048576, 6) AS mib FROM (SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM dir) AS e)", KNN_SQL)
def _(spark, d):
    pts = tables.cut(points(spark, d))
    n, e = pts.count(), weighted(pts).count()
    return spark.createDataFrame([(n, e, potts.estimate_lbp_memory_mb(n, 4, e))], "n_nodes bigint, n_edges bigint, mib double").withColumn("mib", r6("mib"))


@query("profile_crf")
def _(spark, d):
    return workflows.profile_crf(raw(spark, d), tables.block_signatures(spark)).drop("seconds", "size_mb", "total_mb", "peak_mb")
