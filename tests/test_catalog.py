"""Registered queries do their whole job."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import field, potts
from tessella.plans import catalog

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def watched(monkeypatch, module, name):
    """Results of every call of a function."""
    found, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: found.append(f(*a, **b)) or found[-1])
    return found


def test_sweeps_keep_the_plan_small(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "u bigint, v bigint, w double")
    phi = spark.createDataFrame([(i, [0.0, float(i)]) for i in range(6)], "node bigint, phi array<double>")
    b = potts.belief_propagation(chain, phi, 2, 6, tol=0.0)
    assert int(str(b.edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 200


def test_crf_default_runs_to_its_tolerance(spark, monkeypatch):
    found = watched(monkeypatch, potts, "belief_propagation")
    assert catalog.QUERIES["crf_default"](spark, MORE).count() == 6138
    assert found[0].max_delta < 0.1 and found[0].iterations > 10


def test_profile_is_of_the_operators_graph(spark, monkeypatch):
    found = watched(monkeypatch, potts, "belief_propagation")
    row = catalog.QUERIES["profile_crf"](spark, SMALL).first()
    want = catalog.QUERIES["lbp_memory_estimate"](spark, SMALL).first()
    assert (row.n_nodes, row.n_directed_edges) == (want.n_nodes, want.n_edges) and found[0].max_delta < 0.1


def fixed_point(edges, phi):
    """Synchronous sweeps in numpy until nothing moves; marginals by node."""
    at = {r.node: i for i, r in enumerate(phi)}
    u, v, w = np.array([at[r.u] for r in edges]), np.array([at[r.v] for r in edges]), np.array([r.w for r in edges])
    start = np.array([r.phi for r in phi])
    h, uv, vu, change = start, np.zeros((len(u), start.shape[1])), np.zeros((len(u), start.shape[1])), 1.0
    while change > 1e-9:
        new_uv, new_vu = potts.updated_message(h[u], vu, uv, w, 1.0), potts.updated_message(h[v], uv, vu, w, 1.0)
        change, uv, vu, h = max(np.abs(new_uv - uv).max(), np.abs(new_vu - vu).max()), new_uv, new_vu, start.copy()
        np.add.at(h, v, uv)
        np.add.at(h, u, vu)
    p = np.exp(h - h.max(axis=1, keepdims=True))
    return {n: row / row.sum() for (n, _), row in zip(at.items(), p, strict=True)}


def test_lbp_async_ends_at_the_synchronous_fixed_point(spark, monkeypatch):
    found = watched(monkeypatch, potts, "belief_propagation")
    phi = watched(monkeypatch, potts, "node_potentials")
    rows = catalog.QUERIES["lbp_async"](spark, SMALL).collect()
    want = fixed_point(found[0].edges.select("u", "v", "w").collect(), phi[0].collect())
    assert found[0].max_delta < 1e-2 and len(rows) == 4 * len(want)
    assert max(abs(r.p - want[r.node][r.k]) for r in rows) < 0.01


def test_basis_queries_fit_to_the_end(spark, monkeypatch):
    fits = watched(monkeypatch, field, "minimize")
    row = catalog.QUERIES["basis_labels"](spark, SMALL).first()
    assert (row.fit_status, row.fit_iterations) == ("converged", fits[0].iterations) and fits[0].value < 2.5985
    row = catalog.QUERIES["basis_refined_signatures"](spark, SMALL).first()
    assert (row.fit_status, row.refit_status) == ("converged", "converged")
    assert (row.fit_iterations, row.refit_iterations) == (fits[1].iterations, fits[2].iterations) and fits[2].value < 2.902
