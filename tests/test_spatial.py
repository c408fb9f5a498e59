"""Spatial operators against formulas, properties and small hand-made cases."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.vectors import argmax, centered, hilbert_transpose, log_sum_exp, safe_ln, softmax
from tessella.operators import field, filters, graph, hilbert, knn, lattice, potts, signatures
from tessella.plans import workflows
from tessella.sources import tables


def points(spark, n=120, seed=0, genes=8):
    rng = np.random.default_rng(seed)
    rows = [(i, float(x), float(y), float(z), f"g{rng.integers(genes)}", 30.0, True) for i, (x, y, z) in enumerate(rng.random((n, 3)) * 6)]
    return spark.createDataFrame(rows, "tid bigint, x_location double, y_location double, z_location double, feature_name string, qv double, is_gene boolean")


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([-math.inf, 0.0, -math.inf],), ([-800.0, -801.0, -802.0],)], "v array<double>")
    for r in df.select("v", log_sum_exp(F.col("v")).alias("l"), softmax(F.col("v")).alias("s"), argmax(F.col("v")).alias("a"), centered(F.col("v")).alias("c")).collect():
        v = np.array(r.v)
        top = v.max()
        assert r.l == pytest.approx(top + math.log(np.exp(v - top).sum())) and sum(r.s) == pytest.approx(1) and r.a == int(np.argmax(v))
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,)], "x double").select(safe_ln(F.col("x"))).collect()] == [-math.inf, 0.0]


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 5), (3, 1), (3, 3)])
def test_hilbert_is_a_unit_step_walk(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert_transpose(list(grid.T), bits)
    assert sorted(index) == list(range(len(grid)))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_hilbert_order_and_row_index(spark):
    df = points(spark).withColumnsRenamed({"x_location": "x", "y_location": "y"})
    rows = hilbert.hilbert_order(df, ["x", "y"]).collect()
    order = sorted(rows, key=lambda r: (r.hilbert, r.tid))
    assert [r["index"] for r in order] == list(range(1, len(rows) + 1))
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(3)], "tid bigint, x double, y double")
    assert {r.hilbert for r in hilbert.hilbert_index(same, ["x", "y"]).collect()} == {0}
    with pytest.raises(ValueError):
        hilbert.hilbert_index(same.limit(0), ["x", "y"])
    for bad in (0, 31, 2.5, True):
        with pytest.raises(ValueError):
            hilbert.level_of(2, bad)
    with pytest.raises(ValueError):
        hilbert.level_of(3, 22)


def test_filters(spark):
    sig = tables.signatures_from_matrix(spark, np.full((2, 2), 0.5), ["a", "b"], ["t", "u"])
    rows = [(1, 0.0, 0.0, 0.0, "a", 20.0, True), (2, 0.0, 0.0, 0.0, "a", 19.9, True), (3, 0.0, 0.0, 0.0, "a", None, True), (4, 0.0, 0.0, 0.0, "a", 50.0, None), (5, 0.0, 0.0, 0.0, None, 50.0, True), (6, 0.0, 0.0, 0.0, "c", 50.0, True), (7, 0.0, 0.0, 0.0, "b", 50.0, False)]
    df = spark.createDataFrame(rows, points(spark, 1).schema)
    assert [r.tid for r in filters.transcripts(df, sig).collect()] == [1]
    assert filters.filter_counts(df, sig).first().asDict() == {"n_rows": 7, "n_quality": 5, "n_gene": 3, "n_known": 1}
    with pytest.warns(UserWarning):
        assert filters.quality(df.drop("qv")).count() == 7
    with pytest.raises(ValueError):
        filters.gene_rows(df.withColumn("is_gene", F.lit(1)))
    with pytest.raises(Exception, match="finite"):
        filters.transcripts(df.withColumn("y_location", F.lit(float("nan"))), sig).collect()
    with pytest.raises(ValueError):
        tables.check_signatures(sig.withColumn("theta", F.lit(-1.0)))


@pytest.mark.parametrize("basis", ["tri", "bcc"])
def test_barycentric_reproduces_points(spark, basis):
    values = [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]
    d = 2 if basis == "tri" else 3
    rng = np.random.default_rng(1)
    coords = [tuple(map(float, p)) for p in itertools.product(values, repeat=d)] + [tuple(map(float, p)) for p in rng.normal(0, 5, (300, d))]
    df = spark.createDataFrame([(i, *c, *([0.0] * (3 - d))) for i, c in enumerate(coords)], "tid bigint, x double, y double, z double")
    v = lattice.lattice_points(lattice.barycentric(df, basis, 1.3, origin=(0.2,) * d), basis, 1.3, (0.2,) * d)
    axes = ["x", "y", "z"][:d]
    back = v.groupBy("tid").agg(F.sum("w").alias("w"), F.min("w").alias("least"), *[F.sum(F.col("w") * F.col(f"p{a}")).alias(f"b{a}") for a in axes], *[F.first(a).alias(a) for a in axes])
    for r in back.collect():
        assert r.w == pytest.approx(1) and r.least >= 0
        for a in axes:
            assert r[f"b{a}"] == pytest.approx(r[a], abs=1e-9)
    keys = lattice.lattice_keys(basis)
    if basis == "bcc":
        for _, group in itertools.groupby(sorted(v.where("tid > 343").collect(), key=lambda r: r.tid), key=lambda r: r.tid):
            c = [np.array([r[k] for k in keys]) for r in group]
            assert sorted(int(((a - b) ** 2).sum()) for a, b in itertools.combinations(c, 2)) == [3, 3, 3, 3, 4, 4]


def test_lattice_edges(spark):
    grid = spark.createDataFrame([(i, j) for i in range(4) for j in range(3)], "i bigint, j bigint")
    pts = lattice.basis_points(grid, "tri", 2.0)
    got = {(r.m1, r.m2) for r in lattice.lattice_edges(pts, "tri", 2.0).collect()}
    place = {r.basis_id: (r.px, r.py) for r in pts.collect()}
    want = {(a, b) for a in place for b in place if a < b and math.isclose(math.dist(place[a], place[b]), 2.0)}
    assert got == want
    rng = range(-2, 3)
    cells = [(i, j, k) for i in rng for j in rng for k in rng if len({i % 2, j % 2, k % 2}) == 1]
    pts = lattice.basis_points(spark.createDataFrame(cells, "i bigint, j bigint, k bigint"), "bcc", 2.0)
    got = {(r.m1, r.m2): r.distance for r in lattice.lattice_edges(pts, "3d", 2.0).collect()}
    place = {r.basis_id: (r.px, r.py, r.pz) for r in pts.collect()}
    want = {(a, b) for a in place for b in place if a < b and math.dist(place[a], place[b]) < 2.001}
    assert set(got) == want and all(math.isclose(d, math.dist(place[a], place[b])) for (a, b), d in got.items())
    for bad in ("4d", None):
        with pytest.raises(ValueError):
            lattice.basis_kind(bad)
    with pytest.raises(ValueError):
        lattice.check_edge(-1.0)


def test_knn(spark):
    df = points(spark).withColumnsRenamed({"x_location": "x", "y_location": "y", "z_location": "z"})
    df = df.unionByName(df.where("tid < 5").withColumn("tid", F.col("tid") + 1000))  # equal places
    p = {r.tid: np.array([r.x, r.y, r.z]) for r in df.collect()}
    want = set()
    for a in p:
        near = sorted((math.sqrt(((p[a] - p[b]) ** 2).sum()), b) for b in p if b != a)
        want |= {(a, b) for dist, b in near[:4] if dist <= 1.5}
    assert {(r.src, r.dst) for r in knn.knn_edges(df, 4, 1.5).collect()} == want
    with pytest.raises(ValueError):
        knn.knn_edges(df, 0, 1.0)


def test_graph(spark):
    tri = spark.createDataFrame([(0, 1, 0.7), (1, 2, 0.4), (2, 0, 0.9)], "src bigint, dst bigint, w double")
    nodes = spark.range(4).toDF("node")
    both = graph.directed(tri, symmetric=True)
    edges = {r.edge_id: r for r in graph.reverse_edges(both).collect()}
    assert len(edges) == 6 and all((edges[r.rev_id].src, edges[r.rev_id].dst, edges[r.rev_id].w) == (r.dst, r.src, r.w) for r in edges.values())
    assert [(r.node, r.start) for r in graph.row_pointers(both, nodes).orderBy("node").collect()] == [(0, 0), (1, 2), (2, 4), (3, 6)]
    with pytest.raises(Exception, match="no reverse"):
        graph.reverse_edges(graph.directed(tri)).collect()
    assert graph.reverse_edges(graph.directed(tri), check_reverse=False).where("rev_id is null").count() == 3
    with pytest.raises(Exception, match="different weights"):
        graph.directed(tri.union(tri.withColumn("w", F.lit(1.0)))).collect()
    loop = spark.createDataFrame([(1, 1, 1.0)], tri.schema)
    assert graph.directed(loop, symmetric=True).count() == 1 and graph.directed(loop, drop_diagonal=True).count() == 0
    for bad in (tri.withColumn("w", F.lit(float("nan"))), tri.withColumn("dst", F.lit(9).cast("bigint"))):
        with pytest.raises(ValueError):
            graph.check_edges(bad, 3)


def exact(n, k, phi, edges):
    """Marginals by enumeration."""
    out = np.zeros((n, k))
    for x in itertools.product(range(k), repeat=n):
        score = math.exp(sum(phi[i][x[i]] for i in range(n)) + sum(w for u, v, w in edges if x[u] == x[v]))
        for i in range(n):
            out[i, x[i]] += score
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("schedule,damping", [("sync", 1.0), ("sync", 0.95), ("async", 1.0)])
def test_belief_propagation_is_exact_on_a_tree(spark, schedule, damping):
    rng = np.random.default_rng(4)
    phi = np.log(rng.random((5, 3)))
    phi[4, 1] = -math.inf
    edges = [(0, 1, 0.8), (1, 2, 1.5), (1, 3, 0.3), (3, 4, 1.1)]
    e = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    f = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(phi)] + [(9, [0.0, 0.0, math.log(2)])], "node bigint, phi array<double>")
    b = potts.belief_propagation(e, f, 3, max_iter=10, damping=damping, tol=1e-3, schedule=schedule, phases=2)
    got = {r.node: r.p for r in b.marginals.collect()}
    assert np.allclose([got[i] for i in range(5)], exact(5, 3, phi, edges), atol=1e-3) and np.allclose(got[9], [0.25, 0.25, 0.5])
    assert b.max_delta < 1e-3 and len(b.history) == b.iterations


def test_belief_propagation_edges_cases(spark):
    none = spark.createDataFrame([], "u bigint, v bigint, w double")
    f = spark.createDataFrame([(0, [0.0, math.log(3)])], "node bigint, phi array<double>")
    b = potts.belief_propagation(none, f, 2)
    assert b.iterations == 1 and b.mean_delta is None and np.allclose(b.marginals.first().p, [0.25, 0.75])
    with pytest.raises(ValueError):
        potts.belief_propagation(none, f, 2, damping=0.0)
    h = np.array([[0.3, -0.2]])
    assert np.allclose(potts.updated_message(h, np.zeros((1, 2)), np.zeros((1, 2)), np.array([-0.5]), 1.0), math.log(0.5))  # no repulsion
    sig = tables.signatures_from_matrix(spark, np.array([[0.0, 0.0], [1.0, 0.0]]), ["a", "b"], ["t", "u"])
    p = spark.createDataFrame([(1, "a"), (2, "b")], "tid bigint, gene string")
    assert potts.node_potentials(p.where("gene = 'b'"), sig).first().phi == [0.0, -math.inf]
    with pytest.raises(Exception, match="no positive"):
        potts.node_potentials(p, sig).collect()


@settings(max_examples=30, deadline=None)
@given(st.sampled_from(field.REGULARIZATIONS), st.sampled_from(field.PURITIES), st.integers(0, 1000))
def test_penalty_gradients(reg, pur, seed):
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1, (5, 3))
    m1, m2, dist = np.array([0, 1, 2, 0]), np.array([1, 2, 3, 4]), np.array([1.0, 1.5, 1.0, 2.0])
    pen = field.Penalty(0.8, reg, 0.5, 0.7, pur, 0.6)
    total = lambda v: field.smoothness(v, m1, m2, dist, pen)[0] + field.impurity(v, pen)[0]
    grad = field.smoothness(w, m1, m2, dist, pen)[1] + field.impurity(w, pen)[1]
    for i, k in itertools.product(range(5), range(3)):
        step = np.zeros_like(w)
        step[i, k] = 1e-6
        assert (total(w + step) - total(w - step)) / 2e-6 == pytest.approx(grad[i, k], abs=1e-6)


def test_field_fit(spark):
    sig = tables.block_signatures(spark, 8, 2)
    df = points(spark, 300).withColumn("feature_name", F.concat(F.lit("g"), (F.when(F.col("x_location") < 3, 0).otherwise(4) + F.col("tid") % 4).cast("string")))
    found = workflows.spatial_basis(df, sig, 3.0, "tri", refine_signatures=True, maxit=10, refinement_maxit=3)
    assert found.fits[0].value < math.log(8) and np.allclose(found.basis_weights.sum(axis=1), 0)
    right = found.labels.where((F.col("x") < 3) == (F.col("label_k") == 0)).count()
    assert right > 0.95 * 300
    sums = found.signatures.groupBy("k").agg(F.sum("theta").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums) and len(found.signature_history) == 2
    pts = tables.cut(filters.transcripts(df, sig))
    pr = workflows.field_problem(pts, sig, "tri", 3.0)
    w = np.random.default_rng(0).normal(0, 1, (pr.n_basis, 2))
    value, grad = field.likelihood(pr.points, w, pr.log_theta)
    step = np.zeros_like(w)
    step[1, 1] = 1e-5
    up, down = (field.likelihood(pr.points, w + s * step, pr.log_theta)[0] for s in (1, -1))
    assert (up - down) / 2e-5 == pytest.approx(grad[1, 1], abs=1e-6)
    with pytest.raises(ValueError):
        field.Penalty(regularization="cubic")


def test_minimize():
    def rosenbrock(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    found = field.minimize(rosenbrock, np.array([-1.2, 1.0]), 200, 1e-14)
    assert found.status == "converged" and np.allclose(found.w, [1, 1], atol=1e-4)
    with pytest.warns(UserWarning):
        assert field.minimize(rosenbrock, np.array([-1.2, 1.0]), 2).status == "limit"


def test_refinement(spark):
    ref = tables.signatures_from_matrix(spark, np.array([[0.5, 0.2], [0.5, 0.8]]), ["a", "b"], ["t", "u"])
    q = spark.createDataFrame([("a", [0.9, 0.1]), ("a", [0.6, 0.4]), ("b", [0.3, 0.7])], "gene string, posterior array<double>")
    counts = signatures.weighted_counts(signatures.posterior_long(q), 0.35)
    out = {(r.gene, r.k): r for r in signatures.refined(counts, ref, ref, 2.0, 0.25).collect()}
    mean = (1.5 + 2 * 0.5) / (1.5 + 2)
    assert out["a", 0].theta == pytest.approx((0.75 * 0.5 + 0.25 * mean) / 1.0) and out["b", 0].n == 0
    none = signatures.refined(counts.limit(0), ref, ref, 0.0)
    assert {(r.gene, r.k): r.theta for r in none.collect()} == pytest.approx({("a", 0): 0.5, ("b", 0): 0.5, ("a", 1): 0.2, ("b", 1): 0.8})
    assert {r.k: r.effective_count for r in signatures.update_summary(signatures.refined(counts, ref, ref, 2.0)).collect()} == pytest.approx({0: 1.5, 1: 1.1})


def test_crf_and_profile(spark):
    sig = tables.block_signatures(spark, 8, 2)
    df = points(spark, 300)
    found = workflows.run_crf(df, sig, dist_threshold=1.5, max_iter=4)
    rows = found.labels.collect()
    assert len(rows) == 300 and {r.label for r in rows} <= {"type0", "type1"} and sorted(r["index"] for r in rows) == list(range(1, 301))
    got = workflows.profile_crf(df, sig, dist_threshold=1.5, max_iter=2).collect()
    assert [r.stage for r in got] == ["filter", "hilbert_sort", "knn", "graph_build", "node_potentials", "lbp"]
    assert potts.estimate_lbp_memory_mb(10, 4, 20) == (8 * 20 * 4 + 12 * 10 * 4) / 2**20
    with pytest.raises(ValueError):
        workflows.run_crf(df.where("false"), sig)
    with pytest.raises(ValueError):
        workflows.run_crf(df, sig, same_label_ratio=0)


def test_streaming_scores_equal_batch(spark, tmp_path):
    from tessella.streaming.scoring import score_points

    sig = tables.block_signatures(spark, 8, 2)
    pts = tables.cut(filters.transcripts(points(spark, 100), sig)).select("tid", "x", "y", "z", "gene")
    pr = workflows.field_problem(pts, sig, "bcc", 3.0)
    w = np.random.default_rng(0).normal(0, 1, (pr.n_basis, 2))
    batch = {r.tid: r.posterior for r in field.predict(pr.points, w, pr.log_theta).collect()}
    pts.repartition(3).write.parquet(str(tmp_path / "in"))
    genes = sorted({r.gene for r in sig.collect()})
    stream = score_points(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), pr.basis, w, genes, pr.log_theta, "bcc", 3.0)
    run = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {r.tid: r.posterior for r in spark.table("scored").collect()}
    assert got.keys() == batch.keys() and all(np.allclose(got[i], batch[i]) for i in got)
    # lattice points 2**21 apart would have one key: a point that far away has no fitted vertex; an unknown gene no row
    p = pts.first()
    far = spark.createDataFrame([(0, p.x + 1.5 * 2**21, p.y, p.z, p.gene), (1, p.x, p.y, p.z, "nobody"), (2, p.x, p.y, p.z, None)], "tid bigint, x double, y double, z double, gene string")
    rows = score_points(far, pr.basis, w, genes, pr.log_theta, "bcc", 3.0).collect()
    assert [r.tid for r in rows] == [0] and rows[0].logits == [0.0, 0.0]


def small_edges(spark, rows):
    return spark.createDataFrame(rows, "u bigint, v bigint, w double")


def test_a_sweep_is_one_exchange(spark):
    phi = spark.createDataFrame([(i, [0.0, float(i)]) for i in range(4)], "node bigint, phi array<double>")
    edges = small_edges(spark, [(0, 1, 0.5), (1, 2, 0.7)])
    blocks = potts.adjacency_blocks(edges, potts.by_range(phi, 4, 2))
    first = tables.cut(potts.sweep(blocks, potts.no_messages(blocks), 2, 1.0))
    plan = potts.sweep(blocks, first.where("kind < 2"), 2, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan  # of messages; the graph stays where it is
    assert first.columns == ["block", "kind", "slot", "m"] and blocks.count() == 2
    # a sweep's table holds two messages a directed edge and two numbers a block, and no weight or potential
    assert first.agg(F.sum(F.size("m"))).first()[0] == 2 * 4 * 2 + 2 * 2
    assert first.where("kind = 2").agg(F.max(F.col("m")[0])).first()[0] > 0


@pytest.mark.parametrize("rows", [[(0, 1, float("nan"))], [(1, 0, 1.0)], [(1, 1, 1.0)], [(0, 1, 1.0), (0, 1, 2.0)], [(0, None, 1.0)], [(0, 1, None)]])
def test_belief_propagation_checks_edges(spark, rows):
    phi = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(2)], "node bigint, phi array<double>")
    with pytest.raises(ValueError):
        potts.belief_propagation(small_edges(spark, rows), phi, 2)


def test_superseded_states_are_deleted(spark):
    import os

    phi = spark.createDataFrame([(i, [0.0, 0.1 * i]) for i in range(3)], "node bigint, phi array<double>")
    folder = tables._checkpoint_files(tables.cut(phi)).replace("file:", "").rsplit("/", 1)[0]
    before = set(os.listdir(folder))
    found = potts.belief_propagation(small_edges(spark, [(0, 1, 0.5), (1, 2, 0.5)]), phi, 2, 4, tol=0.0)
    assert len(set(os.listdir(folder)) - before) == 1 and found.marginals.count() == 3
    assert [r.iteration for r in potts.history_table(found).orderBy("iteration").collect()] == [1, 2, 3, 4]


def test_csr_and_matrix_checks(spark):
    nodes = spark.range(5).select(F.col("id").alias("node"))
    both = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 3, 2.0), (3, 1, 2.0)], "src bigint, dst bigint, w double")
    found = graph.csr(both, nodes)
    assert [tuple(r) for r in found.pointers.orderBy("node").collect()] == [(0, 0), (1, 1), (2, 3), (3, 3), (4, 4), (5, 4)]
    assert (found.n_nodes, found.n_edges) == (5, 4) and {(r.edge_id, r.rev_id) for r in found.edges.collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    with pytest.raises(ValueError):
        graph.csr(both.unionByName(both.selectExpr("9L AS src", "0L AS dst", "1D AS w")), nodes)
    assert tables.check_matrix(both, 4, 4) is both
    for n, m, rows in ((4, 5, both), (3, 3, both), (4, 4, both.unionByName(both)), (4, 4, both.withColumn("w", F.lit(float("inf"))))):
        with pytest.raises(ValueError):
            tables.check_matrix(rows, n, m)


def test_matrix_to_beliefs(spark):
    """The low-level path: matrix, checked graph, belief propagation."""
    cells = spark.createDataFrame([(0, 1, 0.7), (1, 0, 0.7), (1, 2, 0.4), (2, 1, 0.4), (0, 0, 5.0)], "row int, col int, weight double")
    edges = graph.directed(tables.check_matrix(tables.coo_matrix(cells), 3, 3), drop_diagonal=True)
    phi = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.3, 0.0]), (2, [0.0, 0.0])], "node bigint, phi array<double>")
    found = potts.belief_propagation(graph.undirected(edges), phi, 2, 10, tol=1e-12)
    weights = {}
    for labels in itertools.product(range(2), repeat=3):  # a tree: exact
        score = sum(r.phi[labels[r.node]] for r in phi.collect()) + 0.7 * (labels[0] == labels[1]) + 0.4 * (labels[1] == labels[2])
        for i, k in enumerate(labels):
            weights[i, k] = weights.get((i, k), 0) + math.exp(score)
    for r in found.marginals.collect():
        total = weights[r.node, 0] + weights[r.node, 1]
        assert r.p == pytest.approx([weights[r.node, 0] / total, weights[r.node, 1] / total])


def test_crowded_cube(spark):
    """Many points in one cube: each pair once in either direction."""
    rng = np.random.default_rng(3)
    place = rng.random((150, 3)) * 0.3
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(place)], "tid bigint, x double, y double, z double")
    found = [(r.src, r.dst) for r in knn.radius_pairs(df, 1.0).collect()]
    assert len(found) == len(set(found)) == 150 * 149


def test_weights_are_checked(spark):
    df = spark.createDataFrame([(0.5,), (0.4,), (float("nan"),)], "x double")
    v = F.array(F.struct(F.col("x").alias("w")), F.struct(F.lit(0.5).alias("w")))
    checked = df.select("x", lattice.checked_weights(v).alias("v"))
    assert checked.where("x = 0.5").count() == 1 and checked.where("x = 0.5").first().v is not None
    for bad in ("x = 0.4", "isnan(x)"):
        with pytest.raises(Exception, match="add up to 1"):
            checked.where(bad).collect()


def test_unknown_genes_warn(spark):
    sig = tables.signatures_from_matrix(spark, np.array([[0.7, 0.3], [0.2, 0.8]]), ["g0", "g1"], ["t", "u"])
    with pytest.warns(UserWarning, match="rows have genes with a signature"):
        workflows.run_crf(points(spark, 40, genes=4), sig, max_iter=2, with_order=False)


def test_hilbert_result(spark):
    df = spark.createDataFrame([(i, float(i % 4), float(i // 4)) for i in range(16)], "tid bigint, x double, y double")
    found = hilbert.hilbert_result(df, ["x", "y"], 2)
    assert (found.mins, found.extent, found.bits) == ({"x": 0.0, "y": 0.0}, 3.0, 2)
    rows = found.rows.collect()
    assert sorted(r.hilbert_double for r in rows) == list(range(16)) and all((r.x_scaled, r.y_scaled) == (r.x, r.y) for r in rows)


def test_line_search_keeps_curvature():
    """The valley of Rosenbrock's function, where backtracking alone gives useless steps."""
    def fun(w):
        x, y = w[0]
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([[-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)]])

    fit = field.minimize(fun, np.array([[-1.2, 1.0]]), maxit=200, reltol=1e-14)
    assert fit.w[0] == pytest.approx([1.0, 1.0], abs=1e-4) and fit.status == "converged"


def test_both_ways_of_an_edge_are_one_group(spark):
    rows = [(1, 2, 0.5), (2, 1, 0.5), (3, 1, 0.5), (4, 4, 0.5), (None, 5, 0.5), (5, None, 0.5), (6, None, 0.5), (None, None, 0.5)]
    found = graph.directed(spark.createDataFrame(rows, "src bigint, dst bigint, w double"), symmetric=True)
    want = {(a, b) for s, d, _ in rows for a, b in ((s, d), (d, s))}
    got = [(r.src, r.dst) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Aggregate") == 1


def test_a_row_of_events_is_parsed_once(spark):
    from tessella.plans import catalog

    plan = catalog.points(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("get_json_object") == 1  # filters are on the value, not on the JSON again
    for name in ("graph_degree", "graph_one_way"):  # what they show is made of checkpoints: the table itself is read once
        assert "FileScan" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
