"""Near-duplicate vectors by collision counting over one-dimensional projections.

1. Equal vectors of a label are one class.
2. Unit vectors are projected on many random directions.  ``tables`` groups of ``functions`` directions
   each are sorted: a vector's place along a direction is counted in steps of ``width`` from a random start, and
   vectors of a label with the same places along all directions of a group are a cell.  Both numbers follow from
   the size of the largest label: pairs at the cosine threshold that share no cell are at most ``miss_cell`` of
   all, and the work of sending rows and comparing them is least.  Cells of one vector are dropped before any vector is sent.
3. In a cell every vector opens a window around its own value along the sorted first of ``projections``
   further directions; inside it the directions are counted along which the two values are within
   ``window``.  Pairs that collide often enough (``least``: a pair at the threshold falls short with
   probability ``miss`` at most) are verified by their cosine in double precision.
4. A pair counts in the first group whose cell it shares, so no pair is counted twice.  Cells are cut into blocks
   of ``block`` vectors; a task compares two blocks and returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, forget, in_groups, mix64
from tessella.llm.components import connected_components


def _normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def same_place(width: float, distance: float) -> float:
    """Probability that two values whose difference is normal with that deviation lie in one step of ``width``."""
    z = width / distance
    return 2 * _normal_cdf(z) - 1 - 2 / (z * math.sqrt(2 * math.pi)) * (1 - math.exp(-z * z / 2))


#: Groups of directions at most; a cell's key has 10 bits for its group.
_MOST_TABLES = 1024


@lru_cache(maxsize=8)
def _normals(seed: int, dims: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions and, for each, a random start in [0, 1)."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dims, number)), rng.random(number)


@dataclass(frozen=True)
class Projections:
    cosine: float = 0.93
    width: float = 2.0
    miss_cell: float = 0.05
    projections: int = 24
    miss: float = 1e-6
    spread: float = 2.0
    block: int = 512
    seed: int = 41

    def shape(self, size: int) -> tuple[int, int]:
        """Functions and tables for a label of ``size`` vectors.

        A row of a cell key costs 1, a vector that is sent 15, a compared pair 0.1; unrelated unit vectors are
        about the square root of 2 apart.
        """
        near, far = same_place(self.width, self.distance), same_place(self.width, math.sqrt(2))
        best = None
        for k in range(1, 64):
            tables = max(1, math.ceil(math.log(self.miss_cell) / math.log1p(-(near**k))))
            if tables > _MOST_TABLES:
                break
            others = size * far**k
            cost = tables * (1 + 15 * -math.expm1(-others) + 0.1 * others)
            if best is None or cost < best[0]:
                best = (cost, k, tables)
        return best[1], best[2]

    def directions(self, dims: int) -> np.ndarray:
        """Those that are counted."""
        return _normals(self.seed, dims, self.projections)[0]

    def cells(self, x: np.ndarray, functions: int, tables: int, first: int | None = None) -> np.ndarray:
        """Key of every unit vector's cell in the ``first`` tables (all), without the label: ``(len(x), first)``."""
        a, start = _normals(self.seed + 1, x.shape[1], functions * tables)
        tables = tables if first is None else first
        a, start = a[:, : functions * tables], start[: functions * tables]
        place = np.floor(x @ a / self.width + start).astype(np.int64).reshape(len(x), tables, functions)
        h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), (len(x), tables))
        for k in range(functions):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + place[:, :, k].astype(np.uint64))
        return h

    @cached_property
    def distance(self) -> float:
        """Euclidean distance of unit vectors at the cosine threshold; the projected difference of
        such a pair is normal with this standard deviation."""
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def window(self) -> float:
        return self.spread * self.distance

    @property
    def reach(self) -> float:
        """Half-width of the query-centred window along the sorted direction."""
        z = 1.0
        while 2 * (1 - _normal_cdf(z)) > self.miss:
            z += 0.05
        return z * self.distance

    @cached_property
    def least(self) -> int:
        """Largest count that a pair at the threshold falls short of with probability ``miss`` at most."""
        p = 2 * _normal_cdf(self.spread) - 1
        total, k = 0.0, 0
        while True:
            total += math.comb(self.projections, k) * p**k * (1 - p) ** (self.projections - k)
            if total > self.miss:
                return k
            k += 1


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length: their numbers and their unit vectors."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)
        out.append((at, unit(flat.reshape(len(at), int(n)))))
    return out


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector, k1, k2, usable) of every row; equal vectors have equal keys of 128 bits."""
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False))
    return rows.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector"), "usable": usable})


def _spots(classes: DataFrame, how: Projections, functions: int, tables: int) -> DataFrame:
    """(key, cid): the cell of every class in every table; the last 10 bits of a key are its table."""

    def run(batches):
        table = np.arange(tables, dtype=np.uint64)[None, :]
        for batch in batches:
            cid, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for at, x in _matrices(batch.column(2)) if batch.num_rows else ():
                for lo in range(0, len(at), 512):
                    part = at[lo : lo + 512]
                    key = mix64(how.cells(x[lo : lo + 512], functions, tables) ^ mix64(salt[part] + np.uint64(x.shape[1]))[:, None])
                    key = (key & ~np.uint64(_MOST_TABLES - 1)) | table
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(cid[part], tables))], names=["key", "cid"])

    return classes.select("cid", F.xxhash64("label").alias("salt"), "vector").mapInArrow(run, "key bigint, cid bigint")


def _shared_cells(spots: DataFrame) -> DataFrame:
    """(key, cid, place) of the cells with two classes or more, ``place`` counting from 0 in each; streams over the
    sorted rows and holds none of them."""

    def run(batches):
        last_key = last_cid = None
        place = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = np.append(key[0] == last_key, key[1:] == key[:-1])
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(same, -1, at))
            where = np.where(start >= 0, at - start, at + place + 1)
            both = same | np.append(same[1:], False)  # the last row waits for the next batch
            out_key, out_cid, out_place = key[both], cid[both], where[both]
            if same[0] and place == 0:
                out_key, out_cid, out_place = np.append(last_key, out_key), np.append(last_cid, out_cid), np.append(0, out_place)
            last_key, last_cid, place = key[-1], cid[-1], int(where[-1])
            if len(out_key):
                yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_cid, pa.int64()), pa.array(out_place, pa.int64())], names=["key", "cid", "place"])

    return spots.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(run, "key bigint, cid bigint, place bigint")


def compare(x: np.ndarray, h: np.ndarray, left: np.ndarray, right: np.ndarray, own: bool, how: Projections) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (left, right) whose cosine reaches the threshold, and how many pairs were counted."""
    # neighbouring queries share a window that is little wider than their own
    left, right = (v[np.argsort(h[v, 0], kind="stable")] for v in (left, right))
    sorted_h, slack = h[right, 0], np.float32(1e-5)
    out_a, out_b, counted = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for lo in range(0, len(left), 64):
        q = left[lo : lo + 64]
        s = np.searchsorted(sorted_h, h[q, 0].min() - how.reach - slack)
        e = np.searchsorted(sorted_h, h[q, 0].max() + how.reach + slack, "right")
        r = right[s:e]
        counted += len(q) * len(r)
        count = np.zeros((len(q), len(r)), np.uint8)
        for k in range(how.projections):
            count += np.abs(h[q, k][:, None] - h[r, k][None, :]) <= how.window + slack
        a, b = np.nonzero(count >= how.least)
        a, b = q[a], r[b]
        if own:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 20_000):
            i, j = a[k : k + 20_000], b[k : k + 20_000]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= how.cosine
            out_a.append(i[near])
            out_b.append(j[near])
    return np.concatenate(out_a), np.concatenate(out_b), counted // 2 if own else counted


def _compared(blocks_: DataFrame, how: Projections, functions: int, tables: int) -> DataFrame:
    """(cid, id, links, root) from blocks (key, i, j, side, cid, id, copies, vector), and the pairs counted (cid null)."""

    def run(batches):
        for batch in in_groups(batches, 3):
            key, i, j, side, cid, ids, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
            new = np.ones(len(key) + 1, bool)
            new[1:-1] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            cuts = np.flatnonzero(new)
            links, parent, counted = np.zeros(len(key), np.int64), {}, 0

            def find(a: int, parent=parent) -> int:
                while parent.setdefault(a, a) != a:
                    parent[a] = parent[parent[a]]
                    a = parent[a]
                return a

            for at, x in _matrices(batch.column(7)):
                h = (x @ how.directions(x.shape[1])).astype(np.float32)
                lo = np.searchsorted(at, cuts)
                for n, (s, e) in enumerate(zip(lo[:-1], lo[1:], strict=True)):
                    if e - s < 2:
                        continue
                    own = bool(i[cuts[n]] == j[cuts[n]])
                    left = np.arange(s, e) if own else s + np.flatnonzero(side[at[s:e]] == 0)
                    right = left if own else s + np.flatnonzero(side[at[s:e]] == 1)
                    a, b, pairs = compare(x, h, left, right, own, how)
                    counted += pairs
                    if len(a) and (table := int(key[cuts[n]]) & (_MOST_TABLES - 1)):
                        # the pair belongs to the first table whose cell it shares
                        rows = np.unique(np.concatenate([a, b]))
                        cells = how.cells(x[rows], functions, tables, table)
                        first = ~(cells[np.searchsorted(rows, a)] == cells[np.searchsorted(rows, b)]).any(axis=1)
                        a, b = a[first], b[first]
                    a, b = at[a], at[b]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    for u, v in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
                        u, v = find(u), find(v)
                        parent[max(u, v)] = min(u, v)
            at = np.flatnonzero(links)
            root = [find(u) for u in ids[at].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*cid[at].tolist(), None], pa.int64()), pa.array([*ids[at].tolist(), None], pa.int64()), pa.array([*links[at].tolist(), counted], pa.int64()), pa.array([*root, None], pa.int64())],
                names=["cid", "id", "links", "root"],
            )

    rows = blocks_.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cid")
    return rows.select("key", "i", "j", "side", "cid", "id", "copies", "vector").mapInArrow(run, "cid bigint, id bigint, links bigint, root bigint")


def links_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, how: Projections) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed rows, classes (label, k1, k2, cid, id, copies, vector) and what comparing found (checkpoints)."""
    rows = _keyed(vectors, id_col, vector_col, label_col)
    least = F.min(F.struct(F.col("id").cast("bigint").alias("id"), "vector")).alias("c")
    classes = rows.where("usable").groupBy("label", "k1", "k2").agg(least, F.count("*").alias("copies"))
    classes = cut(classes.select("label", "k1", "k2", F.xxhash64("label", "k1", "k2").alias("cid"), "c.id", "copies", "c.vector"))
    size = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    functions, tables = how.shape(size)
    shared = cut(_shared_cells(_spots(classes, how, functions, tables)))
    number = shared.groupBy("key").agg(F.ceil((F.max("place") + 1) / how.block).alias("blocks"))
    dealt = shared.join(number, "key").withColumn("b", F.floor(F.col("place") / how.block)).join(classes.select("cid", "id", "copies", "vector"), "cid")
    # a block of a cell meets itself and every other one once
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumns(
        {"i": F.least("b", "other"), "j": F.greatest("b", "other"), "side": F.when((F.col("b") <= F.col("other")), 0).otherwise(1)}
    )
    found = cut(_compared(dealt, how, functions, tables))
    forget(shared)
    return rows, classes, found


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", how: Projections = Projections()) -> DataFrame:
    """Per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Only vectors of equal label and length are compared.  A null, empty or zero vector, one with a
    null or non-finite component and one with a null label link with nothing.  Equal vectors
    link with each other.  A null id links with nothing and is not kept.  Rows that share an id
    are separate vectors but one node of a component.  Vectors may be of any length.  Other columns are left alone,
    whatever their names, and an empty table gives an empty result.
    """
    rows, classes, found = links_of(vectors, id_col, vector_col, label_col, how)
    links = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("label", "k1", "k2", "cid", F.col("id").alias("rep"), "copies")
    known = known.join(links, "cid", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").drop("cid")
    known = cut(known.withColumn("linked", F.lit(True)))  # so that the next join alone reads its exchange and can be split
    named = rows.select("id", "label", "usable", "k1", "k2").join(known, ["label", "k1", "k2"], "left")
    linked = F.col("usable") & F.coalesce("linked", F.lit(False))
    component = F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return named.select(
        F.col("id").alias(id_col), F.when(linked, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def share_counted(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", how: Projections = Projections()) -> float:
    """Pairs counted, as a share of all pairs of different vectors of a label."""
    _, classes, found = links_of(vectors, id_col, vector_col, label_col, how)
    counted = found.where("cid is null").agg(F.sum("links")).first()[0] or 0
    n = F.col("count").cast("double")
    every = classes.groupBy("label").count().agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    return counted / every if every else 0.0
