"""A trie of conversation prefixes, and sums over its subtrees by an Euler tour.

Nodes are the different prefixes.  Each has an enter and an exit arc; the tour is the linked list of all arcs.  The
list is ranked in two steps.  Arcs are dealt by the conversation that names their node, so a task holds long runs of
the tour and replaces each by one link; the short list of links is then ranked by pointer doubling, a join a round.
Ranking carries an arc's place together with the leaves and savings from it to the end of the tour, and the difference of
a node's two arcs is its subtree's sum.

Texts leave the scan as digests and lengths; no step gathers a node's children or members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, forget

#: Arcs that a task contracts at once, and ids joined to one text before they are digested.
BLOCK_ARCS, CHUNK_IDS = 200_000, 2_000
#: Links of a list (56 bytes each) up to which it is broadcast in a round of ranking.
SMALL_LIST = 200_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_ENTER, _EXIT = 0, 1


def turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, place, item, chars)``: a conversation's turns from 1 on, with a digest of role and text and the text's code points.

    Turns are in the order of their number, null first, equal ones in that of the digest; a null role or text is empty.
    Rows with a null id belong to no conversation.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    items = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("item"), F.length(text).cast("bigint").alias("chars")
    )
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "item"))
    return items.select("conv", place.alias("place"), "item", "chars")


def rebuilt(rows: DataFrame, every: int = 100, most: int = 6, **names: str) -> DataFrame:
    """``(conv, place, item, chars)`` of conversations that begin like another one; ``place`` 0 stands for each conversation itself.

    A conversation c begins with the first h turns of c - c % ``every`` and goes on with its own after the first h, where h is
    the CRC-32 of its decimal id modulo ``most``.
    """
    own = cut(turns(rows, **names))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    # at most ``most`` - 1 turns a leading conversation, which ``every`` others read
    heads = own.where((F.col("conv") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv", "base")
    begun = own.where("place = 1").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    begun = begun.join(heads, "base").where("place <= h").select("conv", "place", "item", "chars")
    none = F.struct(F.lit(0).alias("place"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("bigint").alias("chars"))
    kept = F.array_compact(F.array(F.when(F.col("place") > h, F.struct("place", "item", "chars")), F.when(F.col("place") == 1, none)))
    return begun.unionByName(own.select("conv", F.explode(kept).alias("t")).select("conv", "t.*"))


def _prefixes(sequences: DataFrame) -> DataFrame:
    """One row a conversation and depth: the prefix's key, that of the prefix before, and whether the conversation ends here."""
    schema = pa.schema([*[(n, pa.int64()) for n in ("k0", "k1", "p0", "p1", "depth", "chars", "conv")], ("ends", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv, place, item, chars in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None:
                    out.append((*held, held[6] != conv))
                if place == 0:
                    held = (0, 0, 0, 0, 0, 0, conv)
                else:
                    before = np.array(held[:2], np.int64).tobytes()
                    k0, k1 = np.frombuffer(hashlib.sha256(before + item).digest()[:16], np.int64).tolist()
                    held = (k0, k1, held[0], held[1], held[4] + 1, chars, conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*held, True), schema, strict=True)], schema=schema)

    dealt = sequences.select("conv", "place", "item", "chars").repartition("conv").sortWithinPartitions("conv", "place")
    return dealt.mapInArrow(run, "k0 bigint, k1 bigint, p0 bigint, p1 bigint, depth bigint, chars bigint, conv bigint, ends boolean")


def _families(nodes: DataFrame) -> DataFrame:
    """Each node followed by its children in the order of their names, range partitioned: ``kind`` 0 is a node, 1 a child of it."""
    zero = F.lit(0).cast("bigint")
    row = lambda g0, g1, kind, *more: F.struct(F.col(g0).alias("g0"), F.col(g1).alias("g1"), F.lit(kind).alias("kind"), "conv", "depth", *[c.alias(n) for c, n in zip(more, ("k0", "k1", "n_convs", "saved"), strict=True)])
    node, child = row("k0", "k1", 0, *map(F.col, ("k0", "k1", "n_convs", "saved"))), row("p0", "p1", 1, zero, zero, zero, zero)
    rows = nodes.select(F.explode(F.array_compact(F.array(node, F.when(F.col("depth") > 0, child)))).alias("r")).select("r.*")
    by = ["g0", "g1", "kind", "conv"]
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()))


_ARC = "conv bigint, arc bigint, next_conv bigint, next_arc bigint, leaves bigint, saved bigint, parent_conv bigint, k0 bigint, k1 bigint, n_convs bigint"


def _arcs(families: DataFrame) -> DataFrame:
    """The tour's arcs with their successors; ``arc`` is twice the depth, plus one for exits.

    A node's enter arc leads to its first child's, or to its exit arc; an exit arc to the next sibling's enter
    arc or the parent's exit arc.  What a partition must know of others is its successor's first row and the last node before it: one row a partition.
    """
    edge = families.groupBy("part").agg(
        F.min(F.struct("g0", "g1", "kind", "conv", "depth")).alias("first"),
        F.max(F.when(F.col("kind") == 0, F.struct("g0", "g1", "conv", "depth"))).alias("last"),
    )
    found = sorted((r.part, tuple(r.first), r.last and (r.last.conv, r.last.depth)) for r in edge.collect())
    after = {p: found[i + 1][1] if i + 1 < len(found) else None for i, (p, _, _) in enumerate(found)}
    before, last = {}, None
    for p, _, header in found:
        before[p] = last
        last = header or last
    schema = pa.schema([(f.split()[0], pa.int64()) for f in _ARC.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node: tuple | None = None  # name and depth of the node whose children come
        held: tuple | None = None
        out: list[tuple] = []

        def add(row: tuple, following: tuple | None) -> None:
            """The arc that a row decides, with the row that follows."""
            g0, g1, kind, conv, depth, k0, k1, n_convs, saved, _ = row
            sibling = following is not None and following[:3] == (g0, g1, 1)
            if kind == 0:
                to = (following[3], 2 * following[4]) if sibling else (conv, 2 * depth + _EXIT)
                out.append((conv, 2 * depth, *to, 0 if sibling else 1, saved, None, k0, k1, n_convs))
                if depth == 0:  # the tour ends here
                    out.append((conv, _EXIT, None, None, 0, 0, None, None, None, None))
            else:
                to = (following[3], 2 * depth) if sibling else (node[0], 2 * node[1] + _EXIT)
                out.append((conv, 2 * depth + _EXIT, *to, 0, 0, node[0], None, None, None))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is None:
                    node = before[row[9]]
                else:
                    add(held, row)
                held = row
                if row[2] == 0:
                    node = (row[3], row[4])
            if out:
                yield flush()
                out.clear()
        if held is not None:
            add(held, after[held[9]])
            yield flush()

    return families.select("g0", "g1", "kind", "conv", "depth", "k0", "k1", "n_convs", "saved", "part").mapInArrow(run, _ARC)


def contracted(conv: np.ndarray, arc: np.ndarray, next_conv: np.ndarray, next_arc: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(head, before, tail)`` of arcs sorted by name: where the run that an arc belongs to begins among them, the weights of
    the run before it, and, for a run's head, where the run ends.

    An arc's successor is found by its name; runs are followed by pointer doubling over the arrays.
    """
    n = len(conv)
    # arcs of one name are neighbours and without a gap, so a place is a subtraction away
    names, first = np.unique(conv, return_index=True)
    lowest, highest = arc[first], arc[np.append(first[1:], n) - 1]
    at = np.minimum(np.searchsorted(names, next_conv), len(names) - 1)
    inside = ~ends & (names[at] == next_conv) & (lowest[at] <= next_arc) & (next_arc <= highest[at])
    succ = first[at] + next_arc - lowest[at]
    here = np.flatnonzero(inside)
    head, before = np.arange(n), np.zeros_like(weights)
    head[succ[here]] = here
    before[succ[here]] = weights[here]
    tail = np.arange(n)
    tail[here] = succ[here]
    while True:
        further = head[head]
        if (further == head).all():
            break
        before, head = before + before[head], further
    while True:
        further = tail[tail]
        if (further == tail).all():
            break
        tail = further
    return head, before, tail


_LINK = "conv bigint, arc bigint, head_conv bigint, head_arc bigint, b0 bigint, b1 bigint, b2 bigint, next_conv bigint, next_arc bigint, t0 bigint, t1 bigint, t2 bigint, parent_conv bigint, k0 bigint, k1 bigint, n_convs bigint"


def _contract(arcs: DataFrame, block_arcs: int) -> DataFrame:
    """Each arc with its run's head and the sums of the run before it; a run's head has the run's successor and sums, too."""
    names = [f.split()[0] for f in _LINK.split(", ")]

    def one(rows: pa.Table) -> pa.RecordBatch:
        of = lambda c: rows.column(c).combine_chunks()
        ints = lambda c: of(c).fill_null(0).to_numpy()
        conv, arc, following = ints("conv"), ints("arc"), (ints("next_conv"), ints("next_arc"))
        ends = of("next_conv").is_null().to_numpy(zero_copy_only=False)
        weights = np.stack([np.ones(len(conv), np.int64), ints("leaves"), ints("saved")], axis=1)
        head, before, tail = contracted(conv, arc, *following, ends, weights)
        is_head = head == np.arange(len(head))
        total = before[tail] + weights[tail]
        hide = lambda v, mask: pa.array(v, pa.int64(), mask=mask)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(conv), pa.array(arc), pa.array(conv[head]), pa.array(arc[head]), *[pa.array(before[:, j]) for j in range(3)],
                *[hide(v[tail], ~is_head | ends[tail]) for v in following], *[hide(total[:, j], ~is_head) for j in range(3)],
                *[of(c) for c in ("parent_conv", "k0", "k1", "n_convs")],
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block_arcs:
                yield one(pa.Table.from_batches(held))
                held = []
        if any(b.num_rows for b in held):
            yield one(pa.Table.from_batches(held))

    return arcs.repartitionByRange("conv", "arc").sortWithinPartitions("conv", "arc").mapInArrow(run, _LINK)


def ranked(links: DataFrame, small: int = SMALL_LIST) -> DataFrame:
    """``(conv, arc, t0, t1, t2)``: sums from each link of a list to its end, by pointer doubling.

    ``links`` has ``conv, arc``, its successor ``next_conv, next_arc`` (null at the end) and what lies before the
    successor.  After r rounds a link has seen 2^r others.  A round looks each link's successor up by a join in which no key is hot: a link
    is the successor of one other at most, and those that are done look themselves up.  Lists of up to ``small`` links, which are
    counted first, are broadcast for that.
    """
    now = cut(links)
    n = now.count()
    few = n <= small
    if few:
        last, now = now, cut(now.coalesce(1 + n // (small // 4)))
        forget(last)
    to = [F.coalesce("next_conv", "conv"), F.coalesce("next_arc", "arc")]
    other = [F.col(c).alias(f"o_{c}") for c in ("conv", "arc", "next_conv", "next_arc", "t0", "t1", "t2")]
    open_ = F.col("next_conv").isNotNull()
    sums = [F.when(open_, F.col(f"t{j}") + F.col(f"o_t{j}")).otherwise(F.col(f"t{j}")).alias(f"t{j}") for j in range(3)]
    nexts = [F.when(open_, F.col(f"o_{c}")).alias(c) for c in ("next_conv", "next_arc")]
    for _ in range(max(n - 1, 0).bit_length()):
        told = now.select(*other)
        met = now.join(F.broadcast(told) if few else told, (to[0] == F.col("o_conv")) & (to[1] == F.col("o_arc")))
        last, now = now, cut(met.select("conv", "arc", *nexts, *sums))
        forget(last)
    return now.select("conv", "arc", "t0", "t1", "t2")


def _ends(prefixes: DataFrame, chunk: int) -> DataFrame:
    """``(k0, k1, ends_sha256)``: digest of the ids of conversations that end at a node, ascending and joined by commas.

    Ids are ranged and joined to texts of ``chunk`` ids first; a digest then reads few rows even where very many conversations are equal.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for a, b, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (a, b) or len(ids) >= chunk:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (a, b), []
                ids.append(conv)
            if out:
                yield packed(out)
                out = []
        if ids:
            yield packed([(*key, ids[0], ",".join(map(str, ids)))])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["k0", "k1", "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        done: list[tuple] = []
        for batch in batches:
            for a, b, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key == (a, b):
                    sha.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield named(done)
                done = []
        if key is not None:
            yield named([(*key, sha.hexdigest())])

    def named(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["k0", "k1", "ends_sha256"])

    by = ["k0", "k1", "conv"]
    chunks = prefixes.where("ends").select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join, "k0 bigint, k1 bigint, least bigint, ids string")
    return chunks.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "least").mapInArrow(digest, "k0 bigint, k1 bigint, ends_sha256 string")


def prefix_trie(sequences: DataFrame, block_arcs: int = BLOCK_ARCS, chunk: int = CHUNK_IDS) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: one row a different prefix.

    ``sequences`` is ``(conv, place, item, chars)`` (see ``turns``) with a row of place 0 for every conversation, turnless
    ones too; ``place`` only orders.  A node is named by its smallest conversation and its depth, from the root (0) on; ``saved_tokens`` is the
    sum over its subtree of ``(n_convs - 1) * chars`` of a node's last item.  Prefixes are told apart by 128 bits of a chained SHA-256.
    Equal conversations share all their nodes.  An empty table gives an empty one (no root).
    """
    prefixes = cut(_prefixes(sequences))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    nodes = prefixes.groupBy("k0", "k1").agg(
        F.min("conv").alias("conv"), F.max("p0").alias("p0"), F.max("p1").alias("p1"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.count("*").alias("n_convs")
    )
    nodes = cut(nodes.select("k0", "k1", "p0", "p1", "conv", "depth", "n_convs", saved))
    families = _families(nodes)
    parts = cut(_contract(_arcs(families), block_arcs))
    forget(families)
    sums = ranked(parts.where("t0 is not null").select("conv", "arc", "next_conv", "next_arc", "t0", "t1", "t2"))
    heads = sums.select(F.col("conv").alias("head_conv"), F.col("arc").alias("head_arc"), "t0", "t1", "t2")
    rest = [(F.col(f"t{j}") - F.col(f"b{j}")).alias(f"s{j}") for j in range(3)]  # from an arc to the end of the tour
    placed = parts.drop("t0", "t1", "t2").join(heads, ["head_conv", "head_arc"]).select("conv", "arc", "parent_conv", "k0", "k1", "n_convs", *rest)
    enter = F.col("arc") % 2 == _ENTER
    between = lambda j: F.sum(F.when(enter, F.col(f"s{j}")).otherwise(-F.col(f"s{j}")))
    whole = placed.groupBy("conv", F.floor(F.col("arc") / 2).alias("depth")).agg(
        F.max("parent_conv").alias("parent_conv_id"), F.max("k0").alias("k0"), F.max("k1").alias("k1"), F.max("n_convs").alias("n_convs"), between(1).alias("n_leaves"), between(2).alias("saved_tokens")
    )
    children = nodes.where("depth > 0").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"))
    return whole.join(children, ["k0", "k1"], "left").join(_ends(prefixes, chunk), ["k0", "k1"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
