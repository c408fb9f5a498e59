"""The softmax field beyond one machine: coefficients, gradient and history in blocks of the lattice.

Coefficients are dealt by ranges of lattice points (owners); points and lattice edges by the range of their first vertex, a
crowded range to several cells.  A cell names, once, the lattice points that it touches; an evaluation then sends owners' rows to
the cells that need them (their own range and a halo), and the cells' sums of gradients back.  Nothing of the size of the
lattice is on the driver or broadcast: it sees sums, and the dot products of a few vectors.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.field import LARGEST, Penalty, _add_rows, _lse, impurity, smoothness
from tessella.sources.tables import cut_by, forget, stored

#: Doubles of a vector in an owner's block, and points of a cell.
SPAN_DOUBLES, CELL_POINTS = 200_000, 100_000
#: Cells of one range of lattice points.
_PARTS = 1 << 20

_SENDS = "block bigint, cell bigint, at array<int>"
_CELL = "cell bigint, need array<bigint>, tid array<bigint>, g array<int>, ids array<int>, ws array<double>, m1 array<int>, m2 array<int>, distance array<double>"


@dataclass
class BlockedField:
    """Points and lattice in cells, what owners send to which cell, and the sizes that penalties are divided by."""

    cells: DataFrame
    sends: DataFrame
    n_basis: int
    n_points: int
    n_edges: int
    types: int
    slots: int
    span: int

    def forget(self) -> None:
        forget(self.cells, self.sends)


def blocked_field(points: DataFrame, edges: DataFrame, n_basis: int, types: int, span: int | None = None, cell_points: int = CELL_POINTS) -> BlockedField:
    """From ``points`` (tid, g, ids, ws) and lattice ``edges`` (m1, m2, distance) over lattice points 0 to ``n_basis`` - 1."""
    span = span or max(1, SPAN_DOUBLES // types)
    home = F.floor(F.array_min("ids") / span)
    at_home = points.select("tid", "g", "ids", "ws", home.alias("home"))
    count = at_home.groupBy("home").agg((F.floor((F.count("*") - 1) / cell_points) + 1).alias("parts"))  # one row a block
    part = F.pmod(F.xxhash64("tid"), F.col("parts"))
    dealt = at_home.join(count, "home").select((F.col("home") * _PARTS + part).alias("cell"), "tid", "g", "ids", "ws")
    links = edges.select((F.floor(F.least("m1", "m2") / span) * _PARTS).alias("of"), "m1", "m2", "distance")
    slots = points.select(F.size("ids")).first()
    if slots is None:
        raise ValueError("no points")
    slots = slots[0]

    def pack(key: tuple, mine: pa.Table, between: pa.Table) -> pa.Table:
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy() if t.num_rows else np.empty(0, np.int64)
        ids, ws = flat(mine, "ids"), flat(mine, "ws").astype(float)
        m1, m2 = between.column("m1").to_numpy(), between.column("m2").to_numpy()
        need, local = np.unique(np.concatenate([ids, m1, m2]), return_inverse=True)
        cuts = np.split(local, [len(ids), len(ids) + len(m1)])
        values = [need, mine.column("tid").to_numpy(), mine.column("g").to_numpy(), cuts[0], ws, cuts[1], cuts[2], between.column("distance").to_numpy()]
        types_ = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *[pa.array([v], pa.list_(t)) for v, t in zip(values, types_, strict=True)]], names=[c.split()[0] for c in _CELL.split(", ")])

    cells = cut_by(dealt.groupBy("cell").cogroup(links.groupBy("of")).applyInArrow(pack, _CELL), "cell")

    def send(batches):
        for batch in batches:
            for cell, need in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = need.values.to_numpy()
                begins = np.flatnonzero(np.diff(ids // span, prepend=-1))
                for part_ids in np.split(ids, begins[1:]):
                    owner = int(part_ids[0] // span)
                    yield pa.RecordBatch.from_arrays([pa.array([owner]), pa.array([cell]), pa.array([part_ids - owner * span], pa.list_(pa.int32()))], names=["block", "cell", "at"])

    sends = cut_by(cells.select("cell", "need").mapInArrow(send, _SENDS), "block")
    n_points, n_edges = cells.agg(F.sum(F.size("tid")), F.sum(F.size("m1"))).first()
    return BlockedField(cells, sends, n_basis, n_points, n_edges, types, slots, span)


# --- vectors


def coefficient_blocks(rows: DataFrame, problem: BlockedField) -> DataFrame:
    """``(block, w)`` of coefficient rows (basis_id, w array); lattice points without a row have zeros."""
    k, span, n = problem.types, problem.span, problem.n_basis

    def pack(key: tuple, mine: pa.Table) -> pa.Table:
        block = key[0].as_py()
        w = np.zeros((min(span, n - block * span), k))
        w[mine.column("basis_id").to_numpy() - block * span] = mine.column("w").combine_chunks().flatten().to_numpy().reshape(-1, k)
        return pa.table([pa.array([block], pa.int64()), pa.array([w.ravel()], pa.list_(pa.float64()))], names=["block", "w"])

    given = rows.select(F.floor(F.col("basis_id") / span).alias("block"), "basis_id", "w").groupBy("block").applyInArrow(pack, "block bigint, w array<double>")
    every = zero_blocks(problem).withColumnsRenamed({"block": "of", "w": "zeros"})
    return every.join(given, F.col("block") == F.col("of"), "left").select(F.col("of").alias("block"), F.coalesce("w", "zeros").alias("w"))


def zero_blocks(problem: BlockedField) -> DataFrame:
    """``(block, w)``, all zero."""
    size = F.least(F.lit(problem.span), F.lit(problem.n_basis) - F.col("id") * problem.span) * problem.types
    blocks = problem.cells.sparkSession.range(-(-problem.n_basis // problem.span))
    return blocks.select(F.col("id").alias("block"), F.array_repeat(F.lit(0.0), size.cast("int")).alias("w"))


def coefficient_rows(blocks: DataFrame, problem: BlockedField) -> DataFrame:
    """``(basis_id, w array)`` of blocks (block, w)."""
    k = problem.types
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / k).cast("int") - 1), lambda i: F.struct((F.col("block") * problem.span + i).alias("basis_id"), F.slice("w", i * k + 1, k).alias("w")))
    return blocks.select(F.explode(rows).alias("r")).select("r.basis_id", "r.w")


def _halo(blocks: DataFrame, problem: BlockedField, vector) -> DataFrame:
    """``(cell, owner, w)``: what each owner sends to each cell, of the vector that ``vector`` makes of the owner's row."""
    k = problem.types

    def run(key: tuple, mine: pa.Table, wanted: pa.Table) -> pa.Table:
        w = vector({c: mine.column(c).combine_chunks().flatten().to_numpy() for c in mine.column_names if c != "block"}).reshape(-1, k)
        at = [x.values.to_numpy() for x in wanted.column("at").combine_chunks()]
        return pa.table([wanted.column("cell"), pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array([w[i].ravel() for i in at], pa.list_(pa.float64()))], names=["cell", "owner", "w"])

    return blocks.groupBy("block").cogroup(problem.sends.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(run, "cell bigint, owner bigint, w array<double>")


def _local(sent: pa.Table, types: int) -> np.ndarray:
    """A cell's coefficients in the order of its lattice points."""
    parts = sent.sort_by("owner").column("w").combine_chunks()
    return parts.flatten().to_numpy().reshape(-1, types)


def _scores(cell: pa.Table, w: np.ndarray, slots: int):
    of = lambda c: cell.column(c).combine_chunks().flatten().to_numpy()
    ids, ws = of("ids").reshape(-1, slots), of("ws").reshape(-1, slots)
    f = np.zeros((len(ids), w.shape[1]))
    for s in range(slots):
        f += ws[:, s, None] * w[ids[:, s]]
    return of, ids, ws, f


def predict_blocks(problem: BlockedField, coefficients: DataFrame, log_theta: np.ndarray) -> DataFrame:
    """``(tid, logits, prior, posterior)`` with coefficient blocks (block, w): a cell gets the rows that its points touch."""
    k, slots = problem.types, problem.slots
    shared = _small(problem, log_theta)

    def run(key: tuple, cell: pa.Table, sent: pa.Table) -> pa.Table:
        of, _, _, f = _scores(cell, _local(sent, k), slots)
        joint = f + shared.value[of("g")]
        pack = lambda v: pa.ListArray.from_arrays(np.arange(0, len(f) * k + 1, k, dtype=np.int32), v.ravel())
        share = lambda v: np.exp(v - _lse(v)[:, None]) if len(v) else v
        return pa.table([pa.array(of("tid")), pack(f), pack(share(f)), pack(share(joint))], names=["tid", "logits", "prior", "posterior"])

    sent = _halo(coefficients, problem, lambda v: v["w"]).withColumnRenamed("cell", "to")
    return problem.cells.groupBy("cell").cogroup(sent.groupBy("to")).applyInArrow(run, "tid bigint, logits array<double>, prior array<double>, posterior array<double>")


def _small(problem: BlockedField, log_theta: np.ndarray):
    """The log signatures, sent to every task; their size is that of the feature table and is checked."""
    if log_theta.size > LARGEST:
        raise ValueError(f"{log_theta.shape[0]} x {log_theta.shape[1]} signatures are too many to send to every task")
    return problem.cells.sparkSession.sparkContext.broadcast(log_theta)


def _cell_gradients(problem: BlockedField, sent: DataFrame, shared, penalty: Penalty, parts: tuple[str, ...] = ("likelihood", "smoothness")) -> DataFrame:
    """``(to_block, cell, at, grad, value)``: cells' sums for each owner, with the cell's part of the objective in one of its rows."""
    k, slots, span, n, n_edges = problem.types, problem.slots, problem.span, problem.n_points, problem.n_edges

    def run(key: tuple, cell: pa.Table, sent: pa.Table) -> pa.Table:
        w = _local(sent, k)
        of, ids, ws, f = _scores(cell, w, slots)
        grad, value = np.zeros_like(w), 0.0
        if "likelihood" in parts and len(f):
            joint = f + shared.value[of("g")]
            a, b = _lse(f), _lse(joint)
            value += float((a - b).sum()) / n
            diff = (np.exp(f - a[:, None]) - np.exp(joint - b[:, None])) / n
            _add_rows(grad, ids, ws, diff)
        m1 = of("m1")
        if "smoothness" in parts and len(m1):
            found, step = smoothness(w, m1, of("m2"), of("distance"), penalty)
            share = len(m1) / n_edges  # the mean over these edges, as a part of the mean over all
            value, grad = value + share * found, grad + share * step
        need = of("need")
        begins = np.flatnonzero(np.diff(need // span, prepend=-1))
        owners = (need[begins] // span).tolist()
        at = [x - o * span for x, o in zip(np.split(need, begins[1:]), owners, strict=True)]
        rows = [g.ravel() for g in np.split(grad, begins[1:])]
        values = [value] + [0.0] * (len(owners) - 1)
        columns = [pa.array(owners, pa.int64()), pa.array([key[0].as_py()] * len(owners), pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(rows, pa.list_(pa.float64())), pa.array(values)]
        return pa.table(columns, names=["to_block", "cell", "at", "grad", "value"])

    cells = problem.cells.groupBy("cell").cogroup(sent.withColumnRenamed("cell", "to").groupBy("to"))
    return cells.applyInArrow(run, "to_block bigint, cell bigint, at array<int>, grad array<double>, value double")


def _owner_gradient(found: pa.Table, w: np.ndarray, problem_size: int, penalty: Penalty) -> tuple[float, np.ndarray]:
    """An owner's part of the objective and its gradient, each lattice point's entries adding up to 0."""
    value, grad = impurity(w, penalty)
    share = len(w) / problem_size
    value, grad = value * share, grad * share
    found = found.sort_by("cell")  # sums in one order, whatever order they come in
    for at, part, v in zip(found.column("at"), found.column("grad"), found.column("value").to_pylist(), strict=True):
        grad[at.values.to_numpy()] += part.values.to_numpy().reshape(-1, w.shape[1])
        value += v
    return value, grad - grad.mean(axis=1, keepdims=True)


def objective_blocks(problem: BlockedField, coefficients: DataFrame, log_theta: np.ndarray, penalty: Penalty, parts: tuple[str, ...] = ("likelihood", "smoothness")) -> DataFrame:
    """``(block, value, grad)``: the parts of the objective (their sum is its value) and of its projected gradient."""
    k, n_basis = problem.types, problem.n_basis
    back = _cell_gradients(problem, _halo(coefficients, problem, lambda v: v["w"]), _small(problem, log_theta), penalty, parts)

    def run(key: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        value, grad = _owner_gradient(found, mine.column("w").combine_chunks().flatten().to_numpy().reshape(-1, k), n_basis, penalty)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([value]), pa.array([grad.ravel()], pa.list_(pa.float64()))], names=["block", "value", "grad"])

    return coefficients.groupBy("block").cogroup(back.groupBy("to_block")).applyInArrow(run, "block bigint, value double, grad array<double>")


# --- the fit

_STATE = pa.schema([("block", pa.int64()), *[(n, pa.list_(pa.float64())) for n in ("w", "grad", "past", "sums")]])


@dataclass
class BlockedFit:
    """How a fit ended; ``w`` (block, w) is a checkpoint."""

    w: DataFrame
    value: float
    status: str
    iterations: int
    evaluations: int
    gradient_norm: float


@dataclass
class _Place:
    """A point of the search: its table, and what the driver knows of it."""

    table: DataFrame
    value: float
    gradient_norm: float
    #: Products of the past steps, the past gradient changes and the gradient, each with each.
    dots: np.ndarray
    steps: int

    def direction(self, use: list[int]) -> tuple[np.ndarray, float]:
        """The two-loop recursion with the past steps ``use``: weights of the vectors whose sum is the direction's opposite, and the slope."""
        n, dots = self.steps, self.dots
        weights, kept = np.zeros(2 * n + 1), []
        weights[2 * n] = 1.0
        for i in reversed(use):
            a = float(dots[i] @ weights) / dots[i, n + i]
            weights[n + i] -= a
            kept.append(a)
        if use:
            i = use[-1]
            weights *= dots[i, n + i] / dots[n + i, n + i]
        for i, a in zip(use, reversed(kept), strict=True):
            weights[i] += a - float(dots[n + i] @ weights) / dots[i, n + i]
        return weights, -float(dots[2 * n] @ weights)


class _Search:
    """Evaluations of the objective at places that are combinations of the vectors at hand, an owner's row at a time."""

    def __init__(self, problem: BlockedField, log_theta: np.ndarray, penalty: Penalty):
        self.problem, self.penalty, self.shared, self.evaluations = problem, penalty, _small(problem, log_theta), 0

    def begin(self, start: DataFrame) -> _Place:
        return self._evaluate(start, lambda v: v["w"], None)

    def step(self, at: _Place, weights: np.ndarray, length: float, use: list[int]) -> _Place:
        """The place ``length`` along minus the combination ``weights`` of the vectors of ``at``; its past is ``use`` of that of ``at`` and this step."""
        n = at.steps

        def vector(had: dict) -> np.ndarray:
            return had["w"] - length * (weights @ np.vstack([had["past"].reshape(2 * n, len(had["w"])), had["grad"]]))

        return self._evaluate(at.table.select("block", "w", "grad", "past"), vector, use)

    def _evaluate(self, state: DataFrame, vector, use: list[int] | None) -> _Place:
        problem, penalty, k, n_basis = self.problem, self.penalty, self.problem.types, self.problem.n_basis
        self.evaluations += 1
        back = _cell_gradients(problem, _halo(state, problem, vector), self.shared, penalty)
        steps = 0 if use is None else len(use) + 1

        def run(key: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
            had = {c: mine.column(c).combine_chunks().flatten().to_numpy() for c in mine.column_names if c != "block"}
            w = vector(had)
            value, grad = _owner_gradient(found, w.reshape(-1, k), n_basis, penalty)
            grad = grad.ravel()
            past = np.empty((0, len(w)))
            if use is not None:
                s, y = had["past"].reshape(2, -1, len(w)) if len(had["past"]) else np.empty((2, 0, len(w)))
                past = np.vstack([s[use], w - had["w"], y[use], grad - had["grad"]])
            every = np.vstack([past, grad])
            sums = np.append([value, np.abs(grad).max()], (every @ every.T).ravel())
            row = (key[0].as_py(), w, grad, past.ravel(), sums)
            return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, _STATE.types, strict=True)], schema=_STATE)

        columns = "block bigint, w array<double>, grad array<double>, past array<double>, sums array<double>"
        out = stored(state.groupBy("block").cogroup(back.groupBy("to_block")).applyInArrow(run, columns))
        found = out.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("total"), F.max("v").alias("top")).orderBy("i").collect()
        size = 2 * steps + 1
        return _Place(out, found[0].total, found[1].top, np.array([r.total for r in found[2:]]).reshape(size, size), steps)


def minimize_blocks(problem: BlockedField, log_theta: np.ndarray, penalty: Penalty, start: DataFrame, maxit: int = 100, reltol: float = 1e-6, memory: int = 5) -> BlockedFit:
    """``field.minimize`` of the objective from the coefficient blocks ``start`` (block, w), with every vector in blocks.

    The driver makes the two-loop recursion from the products of the vectors, which owners add up while they write
    their rows; an evaluation is one job and a sum over blocks.  Superseded places are deleted.
    """
    search = _Search(problem, log_theta, penalty)
    at, use, status, turn = search.begin(start), [], "limit", 0
    for turn in range(1, maxit + 1):
        weights, slope = at.direction(use)
        if slope >= 0:
            use = []
            weights, slope = at.direction(use)
        if slope == 0:
            status = "converged"
            break
        step = 1.0 if use else min(1.0, 1.0 / math.sqrt(-slope))
        low, high, best = 0.0, math.inf, None
        for _ in range(30):
            new = search.step(at, weights, step, use)
            along = float(new.dots[2 * new.steps, new.steps - 1]) / step
            if not new.value <= at.value + 1e-4 * step * slope:  # too long
                high = step
                forget(new.table)
            elif along < 0.9 * slope:  # still falling steeply: too short
                low = step
                forget(best and best.table)
                best = new
            else:
                forget(best and best.table)
                best = new
                break
            step = (low + high) / 2 if high < math.inf else 2 * low
        if best is None:
            status = "stalled"
            break
        last = best.steps - 1
        grows = best.dots[last, 2 * best.steps - 1] > 1e-12  # the step and its change of the gradient agree
        use = list(range(best.steps if grows else last))[-memory:]
        drop, scale = at.value - best.value, max(abs(at.value), abs(best.value), 1.0)
        forget(at.table)
        at = best
        if drop <= reltol * scale:
            status = "converged"
            break
    if status != "converged":
        warnings.warn(f"the fit ended with status '{status}' after {turn} of {maxit} iterations", stacklevel=2)
    return BlockedFit(at.table.select("block", "w"), at.value, status, turn, search.evaluations, at.gradient_norm)
