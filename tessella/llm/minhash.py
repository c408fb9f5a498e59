"""Near-duplicate documents: an LSH forest over MinHash signatures.

1. A document's set is its distinct word shingles (64-bit hashes).  Documents with equal sets
   are one class, represented by its smallest id.
2. Every class has a signature of ``trees * depth`` minima.  Tree t sorts the classes by the
   signature read from column ``t * depth`` on; classes that agree on the first ``depth`` values
   are a region.  Regions of one class are dropped before anything wide is shuffled.
3. In a region's sorted order the common prefix of neighbours is computed.  A region is cut deeper and
   deeper by it until no part has more than ``small`` classes (adaptive depth); candidates are all pairs of such a
   part and, in the whole region, the ``neighbours`` next in order, which have the longest common
   prefixes.  A spanning forest of the candidates whose signatures agree enough goes on.
4. Those few pairs are verified on full sets, and verified links make components.
5. Where a part was cut from a larger region, or a pair failed, classes of different components may
   still be linked.  There the signatures of all pairs across components are compared, in blocks; classes that
   agree with one of another component meet once more in blocks with their full sets, and every
   such pair is verified unless links connect it already.  Tasks return spanning links, never the pairs.

At similarity 0.8 a pair shares no region with probability (1 - 0.8**4)**24 = 3e-6, and
falls under the agreement ``floor`` with probability below 1e-4.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import FOLD, WINDOW_BASE, Words, blocks, cut, forget, in_groups, mix64
from tessella.llm.components import connected_components


@dataclass(frozen=True)
class Forest:
    """``chunk`` classes of a region and ``block_bytes`` of sets fit a task's memory."""

    trees: int = 24
    depth: int = 4
    shingle: int = 5
    percent: int = 80
    floor: float = 0.64
    small: int = 16
    neighbours: int = 6
    chunk: int = 1024
    block_bytes: int = 4 << 20

    @property
    def width(self) -> int:
        return self.trees * self.depth


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one shingle of them all."""
    words = Words(texts, FOLD)
    at, h = words.windows(size)
    cuts = np.searchsorted(at, words.starts)
    h = mix64(h)
    out = []
    for i, n in enumerate(words.counts):
        if 0 < n < size:
            own = words.hash[words.starts[i] : words.starts[i + 1]]
            value = np.full(1, n, np.uint64)
            for w in own:
                value = value * WINDOW_BASE + w
            out.append(mix64(value))
        else:
            out.append(np.unique(h[cuts[i] : cuts[i + 1]]))
    return out


def signatures(sets: list[np.ndarray], width: int) -> np.ndarray:
    """MinHash signatures (uint32) of non-empty sets."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    rng = np.random.default_rng(77)
    times = rng.integers(0, 1 << 31, width, np.uint32) * np.uint32(2) + np.uint32(1)
    mask = rng.integers(0, 1 << 32, width, np.uint32)
    out = np.empty((len(sets), width), np.uint32)
    for k in range(width):
        out[:, k] = np.minimum.reduceat((flat ^ mask[k]) * times[k], at)
    return out


def _sketch(docs: DataFrame, forest: Forest) -> DataFrame:
    """(id, n, k1, k2, sig): set size, 128-bit key of the set and 16 bits of each minimum."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks([len(t or "") for t in texts]):
                sets = shingle_sets(texts[a:b], forest.shingle)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                key = np.zeros((b - a, 2), np.int64)
                sig: list[bytes | None] = [None] * (b - a)
                if len(full):
                    own = [sets[i] for i in full]
                    flat = np.concatenate(own)
                    at = np.cumsum([0] + [len(s) for s in own[:-1]])
                    key[full, 0] = np.add.reduceat(mix64(flat), at).view(np.int64)
                    key[full, 1] = np.add.reduceat(mix64(flat ^ WINDOW_BASE), at).view(np.int64)
                    minima = signatures(own, forest.width)
                    short = (minima >> np.uint32(16)).astype(">u2") ^ minima.astype(">u2")
                    for i, row in zip(full, short, strict=True):
                        sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sig, pa.binary())],
                    names=["id", "n", "k1", "k2", "sig"],
                )

    return docs.mapInArrow(run, "id bigint, n bigint, k1 bigint, k2 bigint, sig binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), width)


def _region_keys(classes: DataFrame, forest: Forest) -> DataFrame:
    """(key, tree, id) of every class in every tree; the key hashes the tree and its first values."""

    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column(1), forest.width).astype(np.uint64)
            for t in range(forest.trees):
                h = np.full(len(sig), t + 1, np.uint64)
                for k in range(forest.depth):
                    h = mix64(h * WINDOW_BASE + sig[:, t * forest.depth + k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.full(len(h), t, np.int32)), batch.column(0)], names=["key", "tree", "id"]
                )

    return classes.select("id", "sig").mapInArrow(run, "key bigint, tree int, id bigint")


def _bounds(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]) + 1, bool)
    new[1:-1] = False
    for v in columns:
        new[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _forest_of(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of a maximum spanning forest's edges."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i in np.lexsort((b, a, -weight)):
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            parent[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


_PAIRS = "a bigint, b bigint"


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _chunks(members: DataFrame, width: int, forest: Forest) -> DataFrame:
    """Adds ``chunk``: 0 in regions that fit; larger ones are cut by a prefix twice, then four times as
    deep, and what still agrees there (nearly equal signatures) by a hash of the id."""
    fits = members.where(F.col("size") <= forest.chunk).withColumn("chunk", F.lit(0).cast("bigint"))
    large = members.where(F.col("size") > forest.chunk).withColumns(
        {"p1": F.xxhash64(F.expr(f"substring(sig, 1, {2 * width})")), "p2": F.xxhash64(F.expr(f"substring(sig, 1, {4 * width})"))}
    )
    n1 = large.groupBy("key", "p1").agg(F.count("*").alias("n1"))
    n2 = large.groupBy("key", "p2").agg(F.count("*").alias("n2"))
    dealt = F.xxhash64("p2", F.pmod(F.xxhash64("id"), F.ceil(F.col("n2") / forest.chunk)))
    chunk = F.when(F.col("n1") <= forest.chunk, F.col("p1")).when(F.col("n2") <= forest.chunk, F.col("p2")).otherwise(dealt)
    cut_up = large.join(n1, ["key", "p1"]).join(n2, ["key", "p2"]).withColumn("chunk", chunk)
    return fits.unionByName(cut_up.select(*fits.columns))


def prefix_parts(lcp: np.ndarray, small: int, depth: int, width: int) -> np.ndarray:
    """Number of the part that each class of a sorted order belongs to.

    ``lcp[i]`` is the length of the common prefix of classes i - 1 and i (below ``depth`` where a region
    begins).  Parts of more than ``small`` classes are cut where their neighbours share one value less, again
    and again; classes of equal signatures stay together.
    """
    new = lcp < depth
    new[0] = True
    for d in range(depth + 1, width + 1):
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] > small
        if not long.any():
            break
        new |= long & (lcp < d)
    return np.cumsum(new) - 1


def _first_pairs(members: DataFrame, forest: Forest) -> DataFrame:
    """Spanning pairs of agreeing classes in regions and their chunks.

    ``members``: (key, chunk, id, sig), sig being read from the tree's columns on.
    """

    def run(batches):
        for batch in in_groups(batches, 2):
            key, chunk, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            sig = _matrix(batch.column(3), forest.width)
            differ = sig[1:] != sig[:-1]
            lcp = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), forest.width))
            begins = np.ones(len(ids), bool)
            begins[1:] = (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])
            region = np.cumsum(begins)
            part = prefix_parts(np.where(begins, 0, np.maximum(lcp, forest.depth)), forest.small, forest.depth, forest.width)
            size = np.bincount(part)[part]
            left, right, agree = [], [], []
            for step in range(1, min(len(ids), max(forest.small, forest.neighbours + 1))):
                near = region[step:] == region[:-step]
                if not near.any():
                    break
                if step > forest.neighbours:
                    near &= (part[step:] == part[:-step]) & (size[step:] <= forest.small)
                i = np.flatnonzero(near & (ids[step:] != ids[:-step]))
                share = (sig[i] == sig[i + step]).mean(axis=1)
                ok = share >= forest.floor
                left.append(i[ok])
                right.append(i[ok] + step)
                agree.append(share[ok])
            if not left:
                continue
            left, right, agree = np.concatenate(left), np.concatenate(right), np.concatenate(agree)
            if len(left):
                # the order of equals is by ids, so that the forests of different trees have the same pairs
                a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
                keep = _forest_of(a, b, agree)
                yield _pair_batch([a[keep]], [b[keep]])

    rows = members.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "sig", "id")
    return rows.select("key", "chunk", "id", "sig").mapInArrow(run, _PAIRS)


def _across(blocks_: DataFrame, forest: Forest) -> DataFrame:
    """(id, family, root): classes that agree with one of another family, with a family that stands for all that
    a task tied together; from blocks (key, i, j, query, family, id, sig)."""

    def run(batches):
        for batch in in_groups(batches, 3):
            key, i, j, query, family, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            sig = _matrix(batch.column(6), forest.width)
            cuts = _bounds(key, i, j)
            marked = np.zeros(len(ids), bool)
            left, right = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                q, r = s + np.flatnonzero(query[s:e]), s + np.flatnonzero(~query[s:e])
                for lo in range(0, len(q), 64):
                    part = q[lo : lo + 64]
                    share = (sig[part][:, None, :] == sig[r][None, :, :]).mean(axis=2)
                    x, y = np.nonzero((share >= forest.floor) & (family[part][:, None] != family[r][None, :]))
                    marked[part[x]] = True
                    marked[r[y]] = True
                    tie = np.unique(np.column_stack([family[part[x]], family[r[y]]]), axis=0)
                    left.append(tie[:, 0])
                    right.append(tie[:, 1])
            at = np.flatnonzero(marked)
            if len(at):
                root = _roots(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(family[at]), pa.array([root[f] for f in family[at].tolist()], pa.int64())], names=["id", "family", "root"]
                )

    rows = blocks_.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.select("key", "i", "j", "query", "family", "id", "sig").mapInArrow(run, "id bigint, family bigint, root bigint")


def _roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Smallest connected node of every node of the edges."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def _sets_of(docs: DataFrame, wanted: DataFrame, forest: Forest) -> DataFrame:
    """(id, set) of the wanted documents: their full shingle sets, sorted, in binary."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks([len(t or "") for t in texts]):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], forest.shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.binary())], names=["id", "set"])

    return docs.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(run, "id bigint, set binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(both) - inter)


def _verified(pairs: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = np.array([
                _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), forest.percent) for x, y in zip(left, right, strict=True)
            ], bool)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, _PAIRS).distinct()


def _links(rows: DataFrame, forest: Forest) -> DataFrame:
    """Spanning links between classes of different families, from blocks (tied, i, j, side, id, family, sig, set)."""

    def run(batches):
        for batch in in_groups(batches, 3):
            tied, i, j, side, ids, family = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            sig = _matrix(batch.column(6), forest.width)
            sets = batch.column(7)
            cuts = _bounds(tied, i, j)
            a, b = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.slice(s, e - s)]
                for x, y in _verify_block(own, sig[s:e], side[s:e], family[s:e], bool(i[s] == j[s]), forest):
                    a.append(ids[s + x])
                    b.append(ids[s + y])
            if a:
                yield _pair_batch([np.array(a)], [np.array(b)])

    dealt = rows.repartition("tied", "i", "j").sortWithinPartitions("tied", "i", "j", "id")
    return dealt.select("tied", "i", "j", "side", "id", "family", "sig", "set").mapInArrow(run, _PAIRS)


def _verify_block(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, family: np.ndarray, same: bool, forest: Forest) -> list[tuple[int, int]]:
    """Verified pairs of one block, or of two (``side`` 0 and 1), that tie families, best agreement first."""
    n = np.array([len(s) for s in sets])
    q = np.arange(len(sets)) if same else np.flatnonzero(side == 0)
    r = q if same else np.flatnonzero(side == 1)
    left, right, agree = [], [], []
    for lo in range(0, len(q), 64):
        part = q[lo : lo + 64]
        share = (sig[part][:, None, :] == sig[r][None, :, :]).mean(axis=2)
        ok = (share >= forest.floor) & (100 * np.minimum(n[part][:, None], n[r][None, :]) >= forest.percent * np.maximum(n[part][:, None], n[r][None, :]))
        ok &= family[part][:, None] != family[r][None, :]
        if same:
            ok &= part[:, None] < r[None, :]
        x, y = np.nonzero(ok)
        left.append(part[x])
        right.append(r[y])
        agree.append(share[x, y])
    if not left:
        return []
    left, right, agree = np.concatenate(left), np.concatenate(right), np.concatenate(agree)
    _, at = np.unique(family, return_inverse=True)
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.lexsort((right, left, -agree)).tolist():
        x, y = int(left[k]), int(right[k])
        u, v = find(int(at[x])), find(int(at[y]))
        if u != v and _similar(sets[x], sets[y], forest.percent):
            parent[u] = v
            out.append((x, y))
    return out


def _still_apart(shared: DataFrame, classes: DataFrame, comps: DataFrame, failed: DataFrame, forest: Forest) -> DataFrame:
    """(id, family, root) of step 5: the classes that agree with one of another component in a region that was cut, or
    in which a candidate pair failed."""
    marked = failed.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("failed", F.lit(1))
    spots = shared.join(marked, "id", "left").join(comps.select(F.col("node").alias("id"), F.col("component").alias("family")), "id", "left")
    spots = cut(spots.select("key", "id", "tree", "size", "failed", F.coalesce("family", "id").alias("family")))
    per = spots.where("size > 2").groupBy("key", "family").agg(F.count("*").alias("n"), F.max("failed").alias("failed"), F.first("size").alias("size"))
    several = per.groupBy("key").agg(
        F.count("*").alias("parts"), F.max(F.struct("n", "family")).alias("main"), F.sum("n").alias("all"), F.max("failed").alias("any"), F.first("size").alias("members")
    )
    several = several.where((F.col("parts") > 1) & (F.col("any").isNotNull() | (F.col("members") > forest.small)))
    several = several.select("key", F.col("main.family").alias("main"), (F.col("all") - F.col("main.n")).alias("minor"))
    open_ = spots.join(several, "key").join(classes, "id")
    # all but the largest component of a region against the whole region
    ci, cj = F.ceil(F.col("minor") / forest.chunk), F.ceil(F.col("size") / forest.chunk)
    spread = F.xxhash64("id", F.lit(5))
    query = open_.where("family <> main").withColumn("query", F.lit(True)).withColumn("i", F.pmod(spread, ci)).withColumn("j", F.explode(F.sequence(F.lit(0), cj - 1)))
    other = open_.withColumn("query", F.lit(False)).withColumn("j", F.pmod(spread, cj)).withColumn("i", F.explode(F.sequence(F.lit(0), ci - 1)))
    columns = ["key", "i", "j", "query", "family", "id", "sig"]
    out = cut(_across(query.select(columns).unionByName(other.select(columns)), forest).distinct())
    forget(spots)
    return out


def _later_links(apart: DataFrame, classes: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """Verified links between the components that ``apart`` ties, from full sets in pairs of blocks."""
    ties = connected_components(apart.where("family <> root").select(F.col("family").alias("a"), F.col("root").alias("b")).distinct())
    wanted = apart.select("id", "family").distinct().join(ties.select(F.col("node").alias("family"), F.col("component").alias("tied")), "family")
    wanted = cut(wanted.join(sets, "id").join(classes, "id"))
    number = wanted.groupBy("tied").agg(F.ceil(F.sum(F.octet_length("set") + F.octet_length("sig")) / forest.block_bytes).alias("blocks"))
    dealt = wanted.join(number, "tied").withColumn("b", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumns(
        {"i": F.least("b", "other"), "j": F.greatest("b", "other"), "side": F.when(F.col("b") <= F.col("other"), 0).otherwise(1)}
    )
    out = cut(_links(dealt, forest))
    forget(wanted)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    A null or empty text, or one without words, has an empty set and is linked with nothing.  Rows with equal
    sets are linked.  Rows that share an id are one node of the link graph.  A row with a
    null id takes part only as a copy: it gets the component of its equals (null if there are
    none with an id) and is not kept.  Texts of any length are read whole.  Other columns are left alone,
    whatever their names, and an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketch = cut(_sketch(rows, forest))
    full = sketch.where("n > 0 and id is not null")
    keys = cut(full.groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "sig")).alias("c")).select("k1", "k2", "n", F.col("c.id").alias("rep"), F.col("c.sig").alias("sig")))
    classes = keys.select(F.col("rep").alias("id"), "sig")
    spots = _region_keys(classes, forest)
    regions = spots.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(spots.join(regions, "key"))
    width = 2 * forest.depth  # bytes of one prefix
    rolled = F.concat(F.expr(f"substring(sig, tree * {width} + 1)"), F.expr(f"substring(sig, 1, tree * {width})"))
    members = _chunks(shared.join(classes, "id").withColumn("sig", rolled), width, forest)
    first = cut(_first_pairs(members, forest).distinct())
    # the classes of candidate pairs, and those of regions that were cut: step 5 needs no others
    wanted = first.select(F.explode(F.array("a", "b")).alias("id")).unionByName(shared.where(F.col("size") > forest.small).select("id"))
    sets = cut(_sets_of(rows, wanted.distinct(), forest))
    links = cut(_verified(first, sets, forest).unionByName(_same_id(full, keys)))
    comps = connected_components(links)
    apart = _still_apart(shared, classes, comps, first.join(links, ["a", "b"], "left_anti"), forest)
    if not apart.isEmpty():
        later = _later_links(apart, classes, sets, forest)
        if not later.isEmpty():
            stars = comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            comps = connected_components(stars.unionByName(later))
        forget(later)
    forget(shared, first, sets, links, apart)

    named = sketch.select("id", "n", "k1", "k2").join(keys.drop("sig"), ["k1", "k2", "n"], "left")
    named = named.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return named.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _same_id(full: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b): ties an id that has rows of different sets with the classes of all of them."""
    several = full.groupBy("id").agg((F.min("k1") != F.max("k1")).alias("differ")).where("differ").select("id")
    rows = full.join(several, "id", "left_semi").select("id", "k1", "k2", "n").join(keys.drop("sig"), ["k1", "k2", "n"]).where("id <> rep")
    return rows.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """The rows of ``docs`` with their columns, without those that ``near_duplicates`` does not keep.

    Of rows that share an id and have equal texts one stays; others of that id stay, since nothing says that they
    are alike.  Rows with a null id stay, as do rows without words.
    """
    found = cut(near_duplicates(docs, id_col, text_col, forest).where(F.col(id_col).isNotNull()))
    out = docs.join(found.where(~F.col("kept")).select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)
    repeated = found.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("id"))
    if not repeated.isEmpty():
        packed = out.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.length(text_col)).alias("text"))
        once = packed.join(repeated, "id", "left_anti").select("row")
        turn = F.row_number().over(Window.partitionBy("id", "text").orderBy(F.xxhash64("row")))
        several = packed.join(repeated, "id", "left_semi").withColumn("turn", turn).where("turn = 1").select("row")
        out = once.unionByName(several).select("row.*")
    return out.select(*docs.columns)
