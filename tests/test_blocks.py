"""Adjacency blocks, in-place sweeps, the field in blocks and crowded neighbours against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import components, field, field_blocks, knn, lattice, potts
from tessella.plans import catalog, workflows
from tessella.sources import tables

SMALL = "/root/testdata/sf0.001"


def one_after_the_other(edges, phi, sweeps, damping=1.0):
    """Marginals, largest and mean change of in-place sweeps, message by message."""
    at = {n: i for i, n in enumerate(sorted(phi))}
    h = np.array([phi[n] for n in sorted(phi)], float)
    weight = {}
    for u, v, w in edges:
        if u in at and v in at:
            weight[at[u], at[v]] = weight[at[v], at[u]] = w
    m = {e: np.zeros(h.shape[1]) for e in weight}
    lse = lambda x: x.max() + math.log(np.exp(x - x.max()).sum())
    for _ in range(sweeps):
        top = total = 0.0
        for u, v in sorted(weight):
            cavity = h[u] - m[v, u]
            a, s = math.exp(weight[u, v]) - 1, lse(cavity)
            new = np.array([s if a <= 0 else lse(np.array([s, math.log(a) + c])) for c in cavity])
            new = (1 - damping) * m[u, v] + damping * (new - lse(new))
            h[v] += new - m[u, v]
            top, total = max(top, np.abs(new - m[u, v]).max()), total + np.abs(new - m[u, v]).sum()
            m[u, v] = new
    p = np.exp(h - h.max(axis=1, keepdims=True))
    return {n: p[i] / p[i].sum() for n, i in at.items()}, top, total / max(1, len(weight) * h.shape[1])


def graph_of(spark, name):
    if name == "triangle":
        rows = [(0, 1, 0.7), (0, 2, 0.4), (1, 2, 0.9)]
        phi = {0: [0.0, 1.0, -0.5], 1: [0.3, 0.0, 0.1], 2: [0.0, -2.0, 0.4], 9: [0.0, 0.0, 1.0]}
    elif name == "random":
        rng = np.random.default_rng(5)
        pairs = {tuple(sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(90)}
        rows = [(u, v, float(rng.normal(0.5, 0.5))) for u, v in sorted(pairs)]
        phi = {i: rng.normal(size=3).tolist() for i in range(40)}
    else:
        pts = tables.cut(catalog.points(spark, SMALL))
        rows = [tuple(r) for r in workflows.neighbour_graph(pts, 10, 2.0, 5.0).collect()]
        phi = {r.node: r.phi for r in potts.node_potentials(pts, tables.block_signatures(spark)).collect()}
    edges = spark.createDataFrame(rows, "u bigint, v bigint, w double")
    return rows, phi, edges, spark.createDataFrame([(n, [float(x) for x in p]) for n, p in phi.items()], "node bigint, phi array<double>"), len(next(iter(phi.values())))


@pytest.mark.parametrize("name,damping,block_edges", [("triangle", 1.0, 200_000), ("random", 0.8, 200_000), ("points", 1.0, 200_000), ("triangle", 1.0, 2), ("random", 1.0, 40)])
def test_sweeps_in_place_are_those_of_a_loop(spark, monkeypatch, name, damping, block_edges):
    """By whole components, and, where these are larger than a block, by levels."""
    monkeypatch.setattr(potts, "BLOCK_EDGES", block_edges)
    rows, phi, edges, table, types = graph_of(spark, name)
    whole = []
    dealt = potts._dealt
    monkeypatch.setattr(potts, "_dealt", lambda *a: whole.append(dealt(*a)) or whole[-1])
    for sweeps in (1, 3) if name != "random" else (2,):
        found = potts.belief_propagation(edges, table, types, sweeps, damping, tol=0.0, schedule="in_place")
        want, top, mean = one_after_the_other(rows, phi, sweeps, damping)
        got = {r.node: r.p for r in found.marginals.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[n], want[n], atol=1e-9) for n in want)
        assert found.max_delta == pytest.approx(top) and found.mean_delta == pytest.approx(mean)
    assert {w[2] for w in whole} == {block_edges == 200_000}


def test_a_long_chain_of_a_large_component_raises(spark, monkeypatch):
    monkeypatch.setattr(potts, "BLOCK_EDGES", 4)
    monkeypatch.setattr(potts, "MOST_LEVELS", 5)
    monkeypatch.setattr(potts.node_levels, "__defaults__", (5,))
    edges = spark.createDataFrame([(i, i + 1, 0.5) for i in range(12)], "u bigint, v bigint, w double")
    phi = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(13)], "node bigint, phi array<double>")
    with pytest.raises(ValueError, match="chain of more than 5"):
        potts.belief_propagation(edges, phi, 2, schedule="in_place")


@pytest.mark.parametrize("block_edges", [200_000, 30])
def test_blocks_do_not_change_synchronous_sweeps(spark, monkeypatch, block_edges):
    rows, phi, edges, table, types = graph_of(spark, "random")
    want = potts.belief_propagation(edges, table, types, 4, 0.9, tol=0.0)
    monkeypatch.setattr(potts, "BLOCK_EDGES", block_edges)
    monkeypatch.setattr(potts.by_range, "__defaults__", (block_edges,))
    got = potts.belief_propagation(edges, table, types, 4, 0.9, tol=0.0)
    value = lambda b: {r.node: r.p for r in b.marginals.collect()}
    a, b = value(want), value(got)
    assert all(np.allclose(a[n], b[n], atol=1e-12) for n in a) and got.max_delta == pytest.approx(want.max_delta)
    pair = lambda b: {(r.u, r.v): (r.w, *r.muv, *r.mvu) for r in b.edges.collect()}
    x, y = pair(want), pair(got)
    assert x.keys() == y.keys() == {(u, v) for u, v, _ in rows} and all(np.allclose(x[e], y[e]) for e in x)


def test_beliefs_of_a_matrix(spark):
    rows, phi, edges, table, types = graph_of(spark, "triangle")
    cells = [(a, b, w) for u, v, w in rows for a, b in ((u, v), (v, u))] + [(2, 2, 9.0)]
    of = lambda c: spark.createDataFrame(c, "row int, col int, weight double")
    want = {r.node: r.p for r in potts.belief_propagation(edges, table, types, 3, tol=0.0).marginals.collect()}
    got = {r.node: r.p for r in workflows.matrix_beliefs(of(cells), 10, 10, table, types, max_iter=3, tol=0.0).marginals.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[n], want[n]) for n in want)
    for wrong, shape, says in [
        (cells, (10, 9), "square"), (cells[1:], (10, 10), "no reverse"), (cells + cells[:1], (10, 10), "more than once"), ([(0, 1, 5.0), *cells[1:]], (10, 10), "differ"), (cells, (2, 2), "outside"),
        ([(0, 1, math.nan), *cells[1:]], (10, 10), "finite"),
    ]:
        with pytest.raises(ValueError, match=says):
            workflows.matrix_beliefs(of(wrong), *shape, table, types)
    with pytest.raises(ValueError, match="itself"):
        workflows.matrix_beliefs(of(cells), 10, 10, table, types, drop_diagonal=False)


def test_levels_and_components(spark):
    rows = [(0, 1), (1, 5), (2, 5), (5, 6), (8, 9)]
    edges = spark.createDataFrame([(u, v, 1.0) for u, v in rows], "u bigint, v bigint, w double")
    nodes = spark.range(10).withColumnRenamed("id", "node")
    want = {0: 0, 1: 1, 2: 0, 5: 2, 6: 3, 8: 0, 9: 1, 3: 0, 4: 0, 7: 0}
    assert {r.node: r.level for r in potts.node_levels(edges, nodes).collect()} == want
    of = np.array([u for u, v in rows] + [v for u, v in rows])
    to = np.array([v for u, v in rows] + [u for u, v in rows])
    assert potts.levels(10, of, to).tolist() == [want[i] for i in range(10)]
    found = {r.node: r.component for r in components.connected_components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).collect()}
    assert found == {0: 0, 1: 0, 5: 0, 2: 0, 6: 0, 8: 8, 9: 8}


# --- the field in blocks


def small_problem(spark, basis="bcc", span=7, cell_points=10):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, p), f"g{rng.integers(6)}") for i, p in enumerate(rng.random((300, 3)) * 9)]
    pts = spark.createDataFrame(rows, "tid bigint, x double, y double, z double, gene string")
    sig = tables.signatures_from_matrix(spark, rng.random((6, 3)) + 0.05, [f"g{i}" for i in range(6)], ["a", "b", "c"])
    plain = workflows.field_problem(pts, sig, basis, 3.0)
    return plain, field_blocks.blocked_field(plain.points, plain.lattice_edges, plain.n_basis, 3, span, cell_points)


def blocks_of(spark, w, problem):
    return tables.cut(field_blocks.coefficient_blocks(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "basis_id bigint, w array<double>"), problem))


def matrix(blocks, problem):
    found = {r.basis_id: r.w for r in field_blocks.coefficient_rows(blocks, problem).collect()}
    return np.array([found[i] for i in range(problem.n_basis)])


@pytest.mark.parametrize("basis", ["tri", "bcc"])
def test_objective_in_blocks(spark, basis):
    plain, blocks = small_problem(spark, basis)
    assert blocks.cells.count() > -(-blocks.n_basis // 7) > 3  # several cells of one range
    w = np.random.default_rng(1).normal(size=(plain.n_basis, 3))
    w[0] = 700.0, -700.0, 0.0  # extreme probabilities
    table = blocks_of(spark, w, blocks)
    assert np.array_equal(matrix(table, blocks), w)
    for reg, pur in [("quadratic", "none"), ("huber", "entropy"), ("bounded", "gini"), ("quadratic", "gini"), ("huber", "none"), ("bounded", "entropy")]:
        penalty = field.Penalty(0.7, reg, 0.1, 0.2, pur, 0.3)
        value, grad = field.objective(plain.points, w, plain.log_theta, plain.edges, penalty)
        found = tables.cut(field_blocks.objective_blocks(blocks, table, plain.log_theta, penalty))
        assert found.agg(F.sum("value")).first()[0] == pytest.approx(value, rel=1e-10)
        assert np.allclose(matrix(found.select("block", F.col("grad").alias("w")), blocks), grad, atol=1e-12)
        alone = field_blocks.objective_blocks(blocks, table, plain.log_theta, penalty, ("smoothness",)).agg(F.sum("value")).first()[0]
        assert alone == pytest.approx(field.smoothness(w, *plain.edges, penalty)[0] + field.impurity(w, penalty)[0], rel=1e-10)


def test_prediction_in_blocks_broadcasts_no_coefficients(spark):
    plain, blocks = small_problem(spark)
    w = np.random.default_rng(1).normal(size=(plain.n_basis, 3))
    found = field_blocks.predict_blocks(blocks, blocks_of(spark, w, blocks), plain.log_theta)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = {r.tid: r for r in field.predict(plain.points, w, plain.log_theta).collect()}
    got = found.collect()
    assert len(got) == len(want) and all(np.allclose(r[c], want[r.tid][c]) for r in got for c in ("logits", "prior", "posterior"))


def test_fit_in_blocks(spark, monkeypatch):
    plain, blocks = small_problem(spark)
    penalty = field.Penalty(0.01, "quadratic")
    fun = lambda v: field.objective(plain.points, v, plain.log_theta, plain.edges, penalty)
    want = field.minimize(fun, np.zeros((plain.n_basis, 3)), 6, 1e-6)
    got = field_blocks.minimize_blocks(blocks, plain.log_theta, penalty, field_blocks.zero_blocks(blocks), 6, 1e-6)
    assert (got.status, got.iterations, got.evaluations) == (want.status, want.iterations, want.evaluations)
    assert got.value == pytest.approx(want.value, abs=1e-8) and np.allclose(matrix(got.w, blocks), want.w, atol=1e-5)
    with pytest.warns(UserWarning, match="limit"):
        assert field_blocks.minimize_blocks(blocks, plain.log_theta, penalty, field_blocks.zero_blocks(blocks), 2).status == "limit"


def test_a_fit_beyond_the_driver(spark, monkeypatch):
    """With a small limit the whole workflow runs in blocks and ends where the other one does."""
    raw, sig = catalog.raw(spark, SMALL), tables.block_signatures(spark)
    options = {"s": 16.0, "basis": "bcc", "reltol": 1e-4, "maxit": 4, "refine_signatures": True, "refinement_maxit": 2}
    want = workflows.spatial_basis(raw, sig, **options)
    monkeypatch.setattr(field, "LARGEST", 100)
    monkeypatch.setattr(field_blocks, "LARGEST", 100)
    got = workflows.spatial_basis(raw, sig, **options)
    assert isinstance(got.fits[0], field_blocks.BlockedFit) and [f.status for f in got.fits] == [f.status for f in want.fits]
    assert all(a.value == pytest.approx(b.value, abs=1e-8) for a, b in zip(got.fits, want.fits, strict=True))
    label = lambda r: {x.tid: x.label for x in r.labels.collect()}
    assert label(got) == label(want)
    rows = {r.basis_id: r.w for r in got.basis_weights.collect()}
    assert np.allclose([rows[i] for i in range(len(rows))], want.basis_weights, atol=1e-3)


def test_messages_are_those_of_the_log_domain():
    """The kernel's scaled sums against logarithms of sums, with impossible types, wide fields and weights of either sign."""
    rng = np.random.default_rng(8)
    h, back, old = rng.normal(0, 50, (3, 200, 4))
    h[:40, 1] = -np.inf
    w = np.concatenate([[-0.5, 0.0, 1e-12, 600.0], rng.random(196) * 3])
    cavity = np.where(np.isneginf(h), -np.inf, h - back)
    with np.errstate(divide="ignore"):
        strong = np.log(np.maximum(np.expm1(w), 0))[:, None]
    want = np.logaddexp(np.logaddexp.reduce(cavity, axis=1)[:, None], strong + cavity)
    want = want - np.logaddexp.reduce(want, axis=1)[:, None]
    assert np.allclose(potts.updated_message(h, back, old, w, 0.7), 0.3 * old + 0.7 * want, atol=1e-12)


def test_rows_are_added_by_vertex():
    rng = np.random.default_rng(9)
    ids, ws, diff = rng.integers(5, 20, (300, 3)), rng.random((300, 3)), rng.normal(size=(300, 4))
    got, want = np.ones((30, 4)), np.ones((30, 4))
    field._add_rows(got, ids, ws, diff)
    for s in range(3):
        np.add.at(want, ids[:, s], ws[:, s, None] * diff)
    assert np.allclose(got, want, atol=1e-12)
    field._add_rows(got, ids[:0], ws[:0], diff[:0])
    assert np.allclose(got, want, atol=1e-12)


# --- neighbours


def plain_knn(x, ids, k, radius):
    out = set()
    for i in range(len(x)):
        d = np.sqrt(sum((x[:, j] - x[i, j]) ** 2 for j in range(x.shape[1])))
        near = sorted((float(d[j]), ids[j]) for j in np.flatnonzero(d <= radius) if j != i)
        out |= {(ids[i], b, n + 1) for n, (_, b) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("k,radius", [(1, 0.5), (5, 2.0), (40, 1.0)])
def test_crowded_neighbours_are_exact(spark, dims, k, radius):
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.random((150, dims)) * 8 - 4, rng.normal(0, 0.01, (150, dims)), np.full((30, dims), 2.0), np.array([[1e6] * dims])])
    x[-5:-1] = np.arange(4)[:, None] * 0.5  # a grid: ties
    ids = rng.permutation(len(x)).tolist()
    names = ("x", "y", "z")[:dims]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, x, strict=True)], "tid bigint, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    want = plain_knn(x, ids, k, radius)
    for crowd in (0.0, 1e9):
        got = {(r.src, r.dst, r["rank"]) for r in knn.knn_edges(df, k, radius, names, crowd=crowd).collect()}
        assert got == want


def test_a_crowded_cube_is_not_compared_pair_by_pair(spark):
    n, k = 20_000, 10
    rng = np.random.default_rng(0)
    x = np.vstack([rng.random((n - 3000, 3)), np.full((3000, 3), 0.5)])  # one cube; many points at one place
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "tid bigint, x double, y double, z double")
    met = knn.nearest_candidates(df, k, 1.0).count()
    assert met < n * n / 2 / 20
    assert knn.knn_edges(df, k, 1.0).count() == n * k
    assert knn.knn_edges(df.where("false"), k, 1.0).count() == 0


def test_rows_at_one_place_are_measured_once(spark, monkeypatch):
    """Copies add rows to the result, not distances; nothing is broadcast, and a place with many rows is cut."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.random((60, 3)) * 4, 12, axis=0)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "tid bigint, x double, y double, z double")
    monkeypatch.setattr(knn.place_rows, "__defaults__", (None, 5))
    apart = np.sqrt(sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(3)))
    want = {(a, b) for a, b in zip(*np.nonzero(apart <= 1.0), strict=True) if a != b}
    found = knn.radius_pairs(df, 1.0)
    rows = [(r.src, r.dst) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert knn.nearest_candidates(df, 5, 1.0).count() == 60 * 5
    for crowd in (0.0, 1e9):
        got = {(r.src, r.dst, r["rank"]) for r in knn.knn_edges(df, 15, 1.0, crowd=crowd).collect()}
        assert got == plain_knn(x, list(range(len(x))), 15, 1.0)


# --- numbering by appearance, first tetrahedra


def plain_tetrahedron(q, tol=1e-10):
    """The first of all sets of four corners that is a tetrahedron of the lattice and holds the point."""
    low = [[2 * math.floor((c - p) / 2) + p for c in q] for p in (0, 1)]
    found = [tuple(b + 2 * u for b, u in zip(base, up)) for base in low for up in itertools.product((0, 1), repeat=3)]
    for four in itertools.combinations(found, 4):
        if sorted(sum((x - y) ** 2 for x, y in zip(a, b)) for a, b in itertools.combinations(four, 2)) != [3, 3, 3, 3, 4, 4]:
            continue
        w = np.linalg.solve(np.vstack([np.array(four, float).T, np.ones(4)]), np.append(q, 1.0))
        if ((w >= -tol) & (w <= 1 + tol)).all():
            return four, w
    raise AssertionError("no tetrahedron")


def test_first_tetrahedra(spark):
    values = [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]
    cases = list(itertools.product(values, repeat=3)) + [tuple(map(float, p)) for p in np.random.default_rng(0).normal(0, 3, (60, 3))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(cases)], "tid bigint, x double, y double, z double")
    rows = lattice.barycentric(df, "bcc", 2.0, first_fit=True).collect()
    closed = {(r.tid, r.i, r.j, r.k): r.w for r in lattice.barycentric(df, "bcc", 2.0).collect() if r.w > 1e-9}
    got = {}
    for r in sorted(rows, key=lambda r: (r.tid, r.slot)):
        got.setdefault(r.tid, []).append(((r.i, r.j, r.k), r.w))
    for i, q in enumerate(cases):
        four, w = plain_tetrahedron(q)
        assert [v for v, _ in got[i]] == list(four) and np.allclose([x for _, x in got[i]], w, atol=1e-9)
    positive = {(i, *v): x for i, found in got.items() for v, x in found if x > 1e-9}
    assert positive.keys() == closed.keys() and all(abs(positive[k] - closed[k]) < 1e-9 for k in closed)


@pytest.mark.parametrize("basis", ["tri", "bcc"])
@pytest.mark.parametrize("order", ["given", "sorted", "shuffled"])
def test_numbering_by_appearance(spark, basis, order):
    x = np.random.default_rng(7).random((80, 3)) * 9
    x = {"given": x, "sorted": x[np.argsort(x[:, 0])], "shuffled": x[::-1]}[order]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "tid bigint, x double, y double, z double").repartition(3)
    keys = lattice.lattice_keys(basis)
    vertices = tables.cut(lattice.barycentric(df, basis, 3.0, first_fit=True))
    ids = {}
    for r in sorted(vertices.collect(), key=lambda r: (r.slot, r.tid)):
        ids.setdefault(tuple(r[k] for k in keys), len(ids))
    points = tables.cut(lattice.basis_points(vertices, basis, 3.0, by_appearance=True))
    assert {tuple(r[k] for k in keys): r.basis_id for r in points.collect()} == ids
    want = set()
    for p, a in ids.items():
        for offset in [(1, 0), (0, 1), (1, -1)] if basis == "tri" else [(2, 0, 0), (0, 2, 0), (0, 0, 2), *itertools.product((-1, 1), repeat=3)]:
            b = ids.get(tuple(u + v for u, v in zip(p, offset)))
            if b is not None and a < b:
                want.add((a, b))
    assert {(r.m1, r.m2) for r in lattice.lattice_edges(points, basis, 3.0, every=False).collect()} == want
    assert len(want) < lattice.lattice_edges(points, basis, 3.0).count()


def test_wide_signatures(spark):
    wide = spark.createDataFrame([("g0", 0.5, 1), ("g1", 0.5, 0)], "gene string, `T.1` double, b int")
    long = tables.signatures_from_wide(wide)
    assert sorted(tuple(r) for r in long.collect()) == [("g0", 0, "T.1", 0.5), ("g0", 1, "b", 1.0), ("g1", 0, "T.1", 0.5), ("g1", 1, "b", 0.0)]
    assert tables.check_signatures(long) == (2, ["T.1", "b"])
    assert [r.cell_type for r in tables.signatures_from_wide(wide, types=["b"]).where("gene = 'g0'").collect()] == ["b"]
    for bad in (wide.union(wide), wide.selectExpr("CAST(NULL AS STRING) AS gene", "`T.1`", "b"), wide.withColumn("b", F.lit(-1))):
        with pytest.raises(ValueError):
            tables.check_signatures(tables.signatures_from_wide(bad))
    with pytest.raises(ValueError):
        tables.signatures_from_wide(wide, types=["c"])


def test_blocks_and_messages_are_bytes_that_find_their_reverse(spark):
    rng = np.random.default_rng(5)
    n, types = 40, 3
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n - 2, (150, 2)) if a != b})  # the last nodes have no edges
    edges = spark.createDataFrame([(u, v, float(rng.uniform(0.1, 1))) for u, v in pairs], "u bigint, v bigint, w double")
    phi = spark.createDataFrame([(i, rng.normal(size=types).tolist()) for i in range(n)], "node bigint, phi array<double>")
    blocks = potts.adjacency_blocks(edges, potts.by_range(phi, 2 * len(pairs), len(pairs) // 2))
    assert {t for c, t in blocks.dtypes if c != "block"} == {"binary"}
    held = {r.block: {c: np.frombuffer(r[c], kind) for c, kind in potts._ARRAYS.items()} for r in blocks.collect()}
    assert len(held) > 1 and sum(len(b["nbr"]) for b in held.values()) == 2 * len(pairs)
    sender = {k: np.repeat(b["node"], np.diff(b["start"])) for k, b in held.items()}
    for k, b in held.items():
        assert (np.lexsort((b["nbr"], sender[k])) == np.arange(len(b["nbr"]))).all()
        for s, d, to, slot, w in zip(sender[k], b["nbr"], b["to_block"], b["to_slot"], b["w"], strict=True):
            assert sender[to][slot] == d and held[to]["nbr"][slot] == s and held[to]["w"][slot] == w
    numbers = potts.sweep(blocks, potts.no_messages(blocks), types, 0.8)
    packed = potts.sweep(blocks, potts.no_messages(blocks, packed=True), types, 0.8, packed=True)
    want = {(r.block, r.kind, tuple(r.slot or ()), tuple(r.m)) for r in numbers.where("kind < 2").collect()}
    assert {(r.block, r.kind, tuple(np.frombuffer(r.slot or b"", np.int32)), tuple(np.frombuffer(r.m))) for r in packed.where("kind < 2").collect()} == want
    assert {(r.top, r.total) for r in packed.where("kind = 2").collect()} == {tuple(r.m) for r in numbers.where("kind = 2").collect()}


def test_sweeps_of_whole_components_write_no_messages(spark, monkeypatch):
    """The tables that belief propagation writes do not grow with its sweeps; a component larger than a block writes one a sweep, whatever the phases."""
    written = []
    monkeypatch.setattr(potts, "stored", lambda df: written.append(df.columns) or tables.stored(df))
    rows, phi, edges, table, types = graph_of(spark, "random")
    for most, limit, more in ((2, 200_000, 0), (6, 200_000, 0), (3, 40, 3)):
        monkeypatch.setattr(potts, "BLOCK_EDGES", limit)
        written.clear()
        found = potts.belief_propagation(edges, table, types, most, tol=0.0, schedule="async")
        assert found.iterations == most and sum("kind" in c for c in written) == more and len(written) < 12


def test_components_over_several_blocks_are_gathered(spark, monkeypatch):
    """Blocks by range cut every component; each ends in one block, with the values of the loop."""
    monkeypatch.setattr(potts, "BLOCK_EDGES", 60)
    rng = np.random.default_rng(6)
    n, types = 24, 2
    rows = [(u, v, float(rng.uniform(0.2, 1))) for u in range(n) for v in range(u + 1, n) if u % 6 == v % 6 and rng.random() < 0.9]
    phi = {i: rng.normal(size=types).tolist() for i in range(n + 1)}
    edges = spark.createDataFrame(rows, "u bigint, v bigint, w double")
    table = spark.createDataFrame(list(phi.items()), "node bigint, phi array<double>")
    blocks = potts._dealt(edges, table, 2 * len(rows), "sync", 1)
    assert blocks[2] and blocks[0].agg(F.sum("n_out"), F.sum("n_edges")).first() == (0, len(rows)) and blocks[0].count() > 1
    found = potts.belief_propagation(edges, table, types, 50, tol=1e-2, schedule="in_place")
    want, top, mean = one_after_the_other(rows, phi, found.iterations)
    got = {r.node: r.p for r in found.marginals.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)
    assert found.max_delta == pytest.approx(top) and found.mean_delta == pytest.approx(mean) and top < 1e-2
    assert one_after_the_other(rows, phi, found.iterations - 1)[1] >= 1e-2  # not a sweep more than needed


def test_a_long_chain_needs_an_exchange_a_block(spark, monkeypatch):
    """260 neighbours of rising id in a component larger than a block."""
    monkeypatch.setattr(potts, "BLOCK_EDGES", 200)
    rng = np.random.default_rng(7)
    phi = {i: rng.normal(size=2).tolist() for i in range(260)}
    rows = [(i, i + 1, 0.9) for i in range(259)]
    edges, table = spark.createDataFrame(rows, "u bigint, v bigint, w double"), spark.createDataFrame(list(phi.items()), "node bigint, phi array<double>")
    found = potts.belief_propagation(edges, table, 2, 2, tol=0.0, schedule="in_place")
    want, top, _ = one_after_the_other(rows, phi, 2)
    got = {r.node: r.p for r in found.marginals.collect()}
    assert all(np.allclose(got[i], want[i], atol=1e-9) for i in want) and found.max_delta == pytest.approx(top)


def test_a_matrix_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(w):
        seen.add(1)
        return w

    rows, phi, edges, table, types = graph_of(spark, "triangle")
    cells = [(a, b, w) for u, v, w in rows for a, b in ((u, v), (v, u))] + [(2, 2, 9.0)]
    watched_cells = spark.createDataFrame(cells, "row int, col int, weight double").withColumn("weight", watched("weight"))
    workflows.matrix_beliefs(watched_cells, 10, 10, table, types, max_iter=2, tol=0.0).marginals.collect()
    assert seen.value == len(cells)
    with pytest.raises(ValueError, match="1 cells lie outside"):
        workflows.matrix_beliefs(spark.createDataFrame([(0, None, 1.0)], "row int, col int, weight double"), 2, 2, table, types)


def test_labelling_writes_no_messages(spark, monkeypatch):
    written = []
    for module in (potts, workflows):
        monkeypatch.setattr(module, "stored", lambda df: written.append(tables.stored(df)) or written[-1])
    found = workflows.run_crf(catalog.raw(spark, SMALL), tables.block_signatures(spark), with_order=False)
    assert found.iterations > 3 and found.max_delta < 0.1 and not any("kind" in df.columns for df in written)


def test_a_profile_keeps_no_messages_and_no_neighbours(spark, monkeypatch):
    """The lists of neighbours and the order are deleted once they are used."""
    written = []
    for module in (potts, workflows):
        monkeypatch.setattr(module, "stored", lambda df: written.append(tables.stored(df)) or written[-1])
    workflows.profile_crf(catalog.raw(spark, SMALL), tables.block_signatures(spark))
    assert not any("kind" in df.columns for df in written)
    of = lambda c: [df._files is None for df in written if c in df.columns]
    assert of("rank") == [True] and of("hilbert") == [True]
