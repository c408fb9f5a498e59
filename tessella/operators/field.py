"""The softmax field over a lattice: objective, gradient, prediction and its fit.

Coefficients are a ``basis points x types`` matrix on the driver, checked against ``LARGEST`` entries and
broadcast for each evaluation; the points' part of the objective and gradient is added up per
task, then by a grouped sum over lattice points.  Penalties run over the lattice only.
"""

from __future__ import annotations

import functools
import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most coefficients that are held by the driver and broadcast (160 MB of doubles).
LARGEST = 20_000_000
REGULARIZATIONS = ("quadratic", "huber", "bounded")
PURITIES = ("none", "entropy", "gini")


@dataclass(frozen=True)
class Penalty:
    lam: float = 1.0
    regularization: str = "bounded"
    delta: float = 1.0
    sigma: float = 1.0
    purity: str = "none"
    purity_lambda: float = 0.0

    def __post_init__(self):
        if self.regularization not in REGULARIZATIONS or self.purity not in PURITIES:
            raise ValueError("unknown regularization or purity")
        if not (math.isfinite(self.lam) and self.lam >= 0 and math.isfinite(self.purity_lambda) and self.purity_lambda >= 0):
            raise ValueError("penalty weights must be finite and not negative")
        if not (self.delta > 0 and self.sigma > 0 and math.isfinite(self.delta) and math.isfinite(self.sigma)):
            raise ValueError("delta and sigma must be positive and finite")


def _lse(v: np.ndarray) -> np.ndarray:
    top = functools.reduce(np.maximum, v.T)  # types are few, rows many: column by column
    return top + np.log(functools.reduce(np.add, np.exp(v - top[:, None]).T))


def _add_rows(grad: np.ndarray, ids: np.ndarray, ws: np.ndarray, diff: np.ndarray) -> None:
    """Adds each point's ``diff``, times the weights ``ws`` of its vertices, to the rows ``ids``."""
    low = int(ids.min(initial=0))
    for s in range(ids.shape[1]):
        for j in range(diff.shape[1]):
            sums = np.bincount(ids[:, s] - low, ws[:, s] * diff[:, j])
            grad[low : low + len(sums), j] += sums


def points_table(design: DataFrame, genes: DataFrame) -> DataFrame:
    """``(tid, g, ids, ws)``: one row a point with its gene number and its vertices."""
    packed = design.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("slot", "basis_id", "w"))).alias("v"))
    return packed.join(genes, "tid").select("tid", "g", F.transform("v", lambda s: s["basis_id"]).alias("ids"), F.transform("v", lambda s: s["w"]).alias("ws"))


def _logits(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    g = batch.column(0).to_numpy()
    ids = batch.column(1).flatten().to_numpy().reshape(n, -1)
    ws = batch.column(2).flatten().to_numpy().reshape(n, -1)
    return g, ids, ws, np.einsum("na,nak->nk", ws, w[ids])


def likelihood(points: DataFrame, w: np.ndarray, log_theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood and its gradient."""
    m, k = w.shape
    if w.size > LARGEST:
        raise ValueError(f"{m} x {k} coefficients are too many for the driver; use a coarser lattice")
    shared = points.sparkSession.sparkContext.broadcast((w, log_theta))

    def run(batches):
        w, log_theta = shared.value
        grad, loss, count = np.zeros_like(w), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g, ids, ws, f = _logits(batch, w)
            joint = f + log_theta[g]
            a, b = _lse(f), _lse(joint)
            loss, count = loss + float((a - b).sum()), count + len(f)
            diff = np.exp(f - a[:, None]) - np.exp(joint - b[:, None])
            _add_rows(grad, ids, ws, diff)
        at = np.flatnonzero(np.abs(grad).sum(axis=1))
        rows = np.vstack([grad[at], [[loss, count] + [0.0] * (w.shape[1] - 2)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *[pa.array(rows[:, j]) for j in range(w.shape[1])]], names=["m", *[f"g{j}" for j in range(w.shape[1])]])

    names = [f"g{j}" for j in range(k)]
    parts = points.select("g", "ids", "ws").mapInArrow(run, "m bigint, " + ", ".join(f"{n} double" for n in names))
    found = parts.groupBy("m").agg(*[F.sum(n).alias(n) for n in names]).toArrow().to_pandas()
    shared.destroy()
    head = found[found["m"] < 0].iloc[0]
    loss, count = head["g0"], head["g1"]
    if not count:
        raise ValueError("no points")
    grad = np.zeros((m, k))
    body = found[found["m"] >= 0]
    grad[body["m"].to_numpy()] = body[names].to_numpy()
    return loss / count, grad / count


def smoothness(w: np.ndarray, m1: np.ndarray, m2: np.ndarray, distance: np.ndarray, penalty: Penalty) -> tuple[float, np.ndarray]:
    """Mean penalty of slopes along lattice edges and its gradient."""
    grad = np.zeros_like(w)
    if penalty.lam == 0 or not len(m1):
        return 0.0, grad
    r = (w[m1] - w[m2]) / distance[:, None]
    if penalty.regularization == "quadratic":
        rho, d = r * r / 2, r
    elif penalty.regularization == "huber":
        small = np.abs(r) <= penalty.delta
        rho = np.where(small, r * r / 2, penalty.delta * (np.abs(r) - penalty.delta / 2))
        d = np.where(small, r, penalty.delta * np.sign(r))
    else:
        e = np.exp(-r * r / (2 * penalty.sigma**2))
        rho, d = penalty.sigma**2 * (1 - e), r * e
    step = penalty.lam / len(m1) * d / distance[:, None]
    np.add.at(grad, m1, step)
    np.add.at(grad, m2, -step)
    return penalty.lam * float(rho.sum()) / len(m1), grad


def impurity(w: np.ndarray, penalty: Penalty) -> tuple[float, np.ndarray]:
    """Mean entropy or Gini impurity of the lattice points' types and its gradient."""
    if penalty.purity == "none" or penalty.purity_lambda == 0:
        return 0.0, np.zeros_like(w)
    logp = w - _lse(w)[:, None]
    p = np.exp(logp)
    if penalty.purity == "entropy":
        value, d = -(p * logp).sum(axis=1), -(logp + 1)
    else:
        value, d = 1 - (p * p).sum(axis=1), -2 * p
    grad = p * (d - (p * d).sum(axis=1, keepdims=True))
    scale = penalty.purity_lambda / len(w)
    return scale * float(value.sum()), scale * grad


def objective(points: DataFrame, w: np.ndarray, log_theta: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], penalty: Penalty) -> tuple[float, np.ndarray]:
    """Value and gradient; the gradient is projected so that each point's entries add up to 0."""
    parts = (likelihood(points, w, log_theta), smoothness(w, *edges, penalty), impurity(w, penalty))
    grad = sum(g for _, g in parts)
    return sum(v for v, _ in parts), grad - grad.mean(axis=1, keepdims=True)


def predict(points: DataFrame, w: np.ndarray, log_theta: np.ndarray, tid: str = "tid") -> DataFrame:
    """``(tid, logits, prior, posterior)``, arrays; works on a stream too."""
    shared = points.sparkSession.sparkContext.broadcast((w, log_theta))

    def run(batches):
        w, log_theta = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g, _, _, f = _logits(batch, w)
            joint = f + log_theta[g]
            offsets = np.arange(0, (n + 1) * w.shape[1], w.shape[1], dtype=np.int32)
            pack = lambda v: pa.ListArray.from_arrays(offsets, v.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), pack(f), pack(np.exp(f - _lse(f)[:, None])), pack(np.exp(joint - _lse(joint)[:, None]))], names=["tid", "logits", "prior", "posterior"]
            )

    return points.select("g", "ids", "ws", F.col(tid).cast("bigint").alias("tid")).mapInArrow(run, "tid bigint, logits array<double>, prior array<double>, posterior array<double>")


@dataclass
class Fit:
    w: np.ndarray
    value: float
    status: str
    iterations: int
    evaluations: int
    gradient_norm: float


def minimize(fun, start: np.ndarray, maxit: int = 100, reltol: float = 1e-6, memory: int = 5) -> Fit:
    """L-BFGS with a line search for sufficient decrease and curvature, on a function that returns value and gradient.

    Stops when the relative decrease is at most ``reltol`` ('converged'), after ``maxit`` iterations
    ('limit') or when no step lowers the value ('stalled').
    """
    x = start.copy()
    value, grad = fun(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    evaluations, status, turn = 1, "limit", 0
    for turn in range(1, maxit + 1):
        q, kept = grad.copy(), []
        for s, y, rho in reversed(past):
            a = rho * float((s * q).sum())
            q -= a * y
            kept.append(a)
        if past:
            s, y, _ = past[-1]
            q *= float((s * y).sum()) / float((y * y).sum())
        for (s, y, rho), a in zip(past, reversed(kept), strict=True):
            q += (a - rho * float((y * q).sum())) * s
        slope = -float((grad * q).sum())
        if slope >= 0:
            past, q, slope = [], grad.copy(), -float((grad * grad).sum())
        if slope == 0:
            status = "converged"
            break
        step = 1.0 if past else min(1.0, 1.0 / math.sqrt(-slope))
        low, high = 0.0, math.inf
        for _ in range(30):
            new_value, new_grad = fun(x - step * q)
            evaluations += 1
            if not new_value <= value + 1e-4 * step * slope:  # too long
                high = step
            elif -float((new_grad * q).sum()) < 0.9 * slope:  # still falling steeply: too short
                low = step
            else:
                break
            step = (low + high) / 2 if high < math.inf else 2 * low
        else:
            if low == 0:
                status = "stalled"
                break
            step = low  # lowers the value, though its slope is steep
            new_value, new_grad = fun(x - step * q)
            evaluations += 1
        s, y = -step * q, new_grad - grad
        if float((s * y).sum()) > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / float((s * y).sum()))]
        drop, scale = value - new_value, max(abs(value), abs(new_value), 1.0)
        x, value, grad = x + s, new_value, new_grad
        if drop <= reltol * scale:
            status = "converged"
            break
    if status != "converged":
        warnings.warn(f"the fit ended with status '{status}' after {turn} of {maxit} iterations", stacklevel=2)
    return Fit(x, value, status, turn, evaluations, float(np.abs(grad).max()))
