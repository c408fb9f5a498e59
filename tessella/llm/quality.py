"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

1. Every word falls into one of ``buckets`` hashed classes.  A class has a sparse random
   index vector; its word vector is the sum of the index vectors of the words around its
   occurrences in all documents.  Tasks add up their own matrix, then its row chunks are
   summed by two streaming shuffles, so no task holds more than a few chunks at once.
2. A document is pooled to the mean and spread of its word vectors, their agreement with the
   next word's vector, and its length.
3. A two-layer numpy network is fitted on a bounded sample of labelled rows
   (``max_train``) and its probabilities are calibrated by a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Words, blocks, mix64


@dataclass(frozen=True)
class VectorSpace:
    """Sizes of the word-vector matrix: ``buckets * dims`` floats are broadcast (4 MB by default)."""

    bits: int = 14
    dims: int = 64
    nonzeros: int = 4
    window: int = 2

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of the nonzero entries of each class's index vector."""
        h = mix64(np.arange(self.buckets * self.nonzeros)).reshape(self.buckets, self.nonzeros)
        return (h >> np.uint64(1)).astype(np.int64) % self.dims, np.where(h & np.uint64(1), 1.0, -1.0)

    def classes(self, words: Words) -> np.ndarray:
        return (words.hash >> np.uint64(64 - self.bits)).astype(np.int64)


def context_sums(texts: list[str | None], space: VectorSpace, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What these texts add to the flat word-vector matrix."""
    words = Words(texts)
    cls = space.classes(words)
    place, sign = index
    total = np.zeros(space.buckets * space.dims)
    for step in range(1, space.window + 1):
        near = words.doc[:-step] == words.doc[step:] if len(cls) > step else np.empty(0, bool)
        left, right = cls[:-step][near], cls[step:][near]
        for a, b in ((left, right), (right, left)):
            keys = (a * space.dims)[:, None] + place[b]
            total += np.bincount(keys.ravel(), weights=sign[b].ravel(), minlength=len(total))
    return total


_CHUNK = 1 << 14


def _summed(parts: DataFrame, *keys: str) -> DataFrame:
    """Adds up the binary float64 vectors of each key while streaming over the rows."""

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            for key, v in zip(zip(*columns, strict=True), batch.column(len(keys)), strict=True):
                v = np.frombuffer(v.as_buffer(), np.float64)
                if key in sums:
                    sums[key] += v
                else:
                    sums[key] = v.copy()
        for key, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()) for k in key] + [pa.array([v.tobytes()], pa.binary())], names=[*keys, "v"]
            )

    spread = parts.select(*keys, "v").repartition(*keys)
    return spread.mapInArrow(add, ", ".join(f"{k} int" for k in keys) + ", v binary")


def word_vectors(docs: DataFrame, text_col: str = "text", space: VectorSpace = VectorSpace()) -> np.ndarray:
    """Unit word vectors ``(buckets, dims)`` from the contexts in all documents."""

    def partial(batches):
        index, total = space.index(), np.zeros(space.buckets * space.dims)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks([len(t or "") for t in texts], 1_000_000):
                total += context_sums(texts[a:b], space, index)
        task = TaskContext.get().partitionId() // 128
        for c, a in enumerate(range(0, len(total), _CHUNK)):
            if (v := total[a : a + _CHUNK]).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.int32()), pa.array([task], pa.int32()), pa.array([v.tobytes()], pa.binary())],
                    names=["chunk", "task", "v"],
                )

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(partial, "chunk int, task int, v binary")
    matrix = np.zeros(space.buckets * space.dims)
    for row in _summed(_summed(parts, "chunk", "task"), "chunk").collect():
        v = np.frombuffer(row["v"], np.float64)
        matrix[row["chunk"] * _CHUNK : row["chunk"] * _CHUNK + len(v)] = v
    matrix = matrix.reshape(space.buckets, space.dims)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return (matrix / np.maximum(norm, 1e-12)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, space: VectorSpace) -> np.ndarray:
    """One feature row a text; a text without words has zeros."""
    words = Words(texts)
    cls = space.classes(words)
    out = np.zeros((len(texts), 2 * space.dims + 3), np.float32)
    some = np.flatnonzero(words.counts)
    if not len(some):
        return out
    n = words.counts[some][:, None].astype(np.float32)
    at = words.starts[:-1][some]
    v = vectors[cls]
    mean = np.add.reduceat(v, at, axis=0) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(v * v, at, axis=0) / n - mean * mean, 0))
    agree = np.zeros(len(v), np.float32)
    agree[:-1] = np.einsum("ij,ij->i", v[:-1], v[1:]) * (words.doc[:-1] == words.doc[1:])
    out[some] = np.hstack([mean, spread, np.add.reduceat(agree, at)[:, None] / n, np.linalg.norm(mean, axis=1, keepdims=True), np.log1p(n)])
    return out


class Network:
    """One hidden layer of rectified units and a calibrated logistic output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.center, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.center) / self.scale
        order = rng.permutation(len(x))
        held = order[: max(1, len(x) // 6)] if len(x) > 20 else order
        used = order[len(held) :] if len(x) > 20 else order
        d = x.shape[1]
        self.p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        self.temperature = 1.0
        m, v, t = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p], 0
        for _ in range(epochs):
            rng.shuffle(used)
            for a in range(0, len(used), 256):
                i = used[a : a + 256]
                h = np.maximum(x[i] @ self.p[0] + self.p[1], 0)
                e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(e, self.p[2]) * (h > 0)
                grads = [x[i].T @ back + decay * self.p[0], back.sum(0), h.T @ e + decay * self.p[2], np.array([e.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        z, goal = self._logits(x[held]), y[held]
        grid = np.geomspace(0.25, 16, 61)
        loss = [np.mean(np.logaddexp(0, z / k) - goal * z / k) for k in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._logits((x - self.center) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled_sample(labels: DataFrame, label: str, eligible: Column, max_train: int, id_col: str = "doc_id") -> DataFrame:
    """About ``max_train`` labelled ids at most (by a hash of the id), with their label as ``y``.

    A null label or id is left out; an id with several labels has the largest.
    """
    rows = labels.where(eligible & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    share = min(1.0, max_train / max(1, rows.count()))
    return (
        rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(label)), F.lit(1 << 20)) < int(share * (1 << 20)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).cast("double").alias("y"))
    )


def train(
    docs: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id", space: VectorSpace = VectorSpace(),
) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all documents and a network fitted on the ``sample`` of ``labelled_sample``.

    No network if the sample meets no document or has one class only.  Null and empty texts have no words;
    texts of any length are read whole, repeated rows count as often as they are there, and an empty table
    gives vectors of zeros.  Columns other than id and text are left alone, whatever their names.
    """
    vectors = word_vectors(docs, text_col, space)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks([len(t or "") for t in texts]):
                x = pooled(texts[a:b], shared.value, space)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    # the sample is bounded by ``max_train`` rows of two numbers
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
    found = rows.select("y", "text").mapInArrow(features, "y double, x binary").toArrow()
    y = found["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return vectors, None
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(len(y), -1).astype(np.float64)
    order = np.lexsort(np.column_stack([x, y]).T)  # the fit does not depend on the order of rows
    return vectors, Network(x[order], y[order])


def score(
    docs: DataFrame, vectors: np.ndarray, network: Network | None, id_col: str = "doc_id", text_col: str = "text", space: VectorSpace = VectorSpace(),
) -> DataFrame:
    """Per document: id and ``score``, the probability of the label.

    Null and empty texts are scored as texts without words; without a network all get 0.5.  Texts of any length
    are read whole.  Rows are independent, so repeated rows get equal scores; other columns are left
    alone, whatever their names, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        v, net = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, out = batch.column(1).to_pylist(), []
            for a, b in blocks([len(t or "") for t in texts]):
                out.append(np.full(b - a, 0.5) if net is None else net.score(pooled(texts[a:b], v, space).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
