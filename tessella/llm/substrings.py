"""Repeated passages: prefix-partitioned suffix trees over words.

Every word position starts a suffix, cut at ``width`` words.  Suffixes are split into groups by
variable-length prefixes: a suffix belongs to its shortest prefix of 1, 2, 4 or 8 words that is not
too frequent, by counts over all documents, or else to its whole window; prefixes are packed into
groups sized for a task's memory.  A group is a bundle of subtrees, held as its leaves in suffix order: a
leaf's 64-bit label has 8 bits of its 4-word prefix, 8 of its 8-word prefix and 48 of its whole window,
so leaves below one internal node lie together and the common prefix of neighbours is read from their
labels.  The deep internal nodes, those of depth ``width`` with leaves of two or more documents, are the
repeated windows; runs of them in a document are its maximal repeats.

Documents are dealt to blocks that are ranges of the id with about equal text, so whichever block has a
window first also has the smallest id.  An id (or the null id) with more text than a block has blocks of
its own, which all have one place in that order.  A block sends each distinct leaf once, which also keeps a
passage that is in every document to one leaf a block, and gets back one bit for each: whether an
earlier block has it.  Texts are dealt by one exchange that both passes read, leaves by another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import WINDOW_BASE, Words, blocks, covered, cut, forget, in_groups, mix64

#: Lengths of the prefixes, in words.
PREFIXES = (1, 2, 4, 8)
#: Label bits of a leaf from its 4-word and its 8-word prefix; the window has the rest.
_ORDER_BITS = 8


@dataclass(frozen=True)
class Repeats:
    """``block_bytes`` of text a block and ``group_windows`` suffixes a group fit a task's memory.

    A block costs the driver 16 bytes; blocks and groups are dealt to ``most_partitions``
    partitions at most, each of which takes its blocks and groups one after the other.  The table
    of prefix counts has 2**15 to 2**20 places a length (32 MB at most), by the size of the input.
    """

    width: int = 13
    block_bytes: int = 4 << 20
    group_windows: int = 400_000
    most_partitions: int = 20_000

    def partitions(self, number: int) -> int:
        return max(2, min(number, self.most_partitions))

    def table_bits(self, text_bytes: int) -> int:
        """Eight places a group: a text has a suffix in about 6 bytes."""
        return int(np.clip(np.ceil(np.log2(max(1, 8 * text_bytes / 6 / self.group_windows))), 15, 20))


def prefix_hashes(words: Words, at: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the prefixes of each length of the suffixes that start at ``at``."""
    h, done = words.hash[at].copy(), 1
    for n in PREFIXES:
        for k in range(done, n):
            h *= WINDOW_BASE
            h += words.hash[at + k]
        done = n
        yield mix64(h)


#: Blocks at most; their limits are then 256 MB.
_MOST_BLOCKS = 1 << 24


@dataclass(frozen=True)
class Ranges:
    """Blocks of ids: ``limits`` are the largest ids of each range but the last, ascending; null ids have
    a range of their own after it.  Range r has the blocks ``first[r]`` to ``first[r + 1] - 1``."""

    limits: np.ndarray
    first: np.ndarray
    text_bytes: int

    @property
    def blocks(self) -> int:
        return int(self.first[-1])

    def block(self, ids: np.ndarray, null: np.ndarray, spread: np.ndarray) -> np.ndarray:
        r = np.where(null, len(self.limits) + 1, np.searchsorted(self.limits, ids, side="left"))
        return self.first[r] + spread % (self.first[r + 1] - self.first[r])

    def place(self, block: np.ndarray) -> np.ndarray:
        """Number of a block's range: the order of the blocks by id."""
        return np.searchsorted(self.first, block, side="right") - 1


def block_ranges(rows: DataFrame, how: Repeats) -> Ranges:
    """Ranges of the id with about equal text, from the text bytes of every id.

    A running sum over all sorted ids (each partition starts at the sum of those before it) closes a block
    whenever it passes a multiple of ``block_bytes``, so a block holds at most about that and one id more, however the
    ids lie in partitions.  An id of more bytes than a block is a range alone, of as many blocks as
    its bytes fill; its rows are spread over them by a hash of the text.
    """
    sizes = rows.groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).alias("n"))
    ranged = cut(sizes.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("null")).orderBy("part").toArrow()
    known = sums["n"].to_numpy() - sums["null"].to_numpy()
    offsets = dict(zip(sums["part"].to_pylist(), (np.cumsum(known) - known).tolist(), strict=True))
    total, null_bytes = sum(sums["n"].to_pylist()), sum(sums["null"].to_pylist())

    def cuts(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            total = offsets[batch.column(2)[0].as_py()] if total is None else total
            running = total + np.cumsum(sizes)
            full = np.diff(running // how.block_bytes, prepend=total // how.block_bytes) > 0
            total = int(running[-1])
            large = ids[sizes > how.block_bytes]
            parts = np.concatenate([np.maximum(1, -(-sizes[full] // how.block_bytes)), np.ones(len(large), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[full], large - 1])), pa.array(parts)], names=["id", "parts"])

    found = ranged.where("id is not null").mapInArrow(cuts, "id bigint, parts bigint")
    found = found.groupBy("id").agg(F.max("parts").alias("parts")).limit(_MOST_BLOCKS + 1).toArrow()
    forget(ranged)
    if found.num_rows > _MOST_BLOCKS:
        raise ValueError(f"more than {_MOST_BLOCKS} blocks: give larger block_bytes")
    ids, parts = found["id"].to_numpy(), found["parts"].to_numpy()
    order = np.argsort(ids)
    parts = np.concatenate([parts[order], [1, max(1, -(-null_bytes // how.block_bytes))]])
    return Ranges(ids[order], np.concatenate([[0], np.cumsum(parts)]).astype(np.int64), int(total))


def prefix_counts(docs: DataFrame, how: Repeats, bits: int = 15) -> np.ndarray:
    """Suffixes by place for each prefix length, over all documents: ``(len(PREFIXES), 2**bits)``."""

    def count(batches):
        total = np.zeros((len(PREFIXES), 1 << bits), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks([len(t or "") for t in texts]):
                words = Words(texts[a:b])
                at, _ = words.windows(how.width)
                for row, h in zip(total, prefix_hashes(words, at), strict=True):
                    row += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        for k, row in enumerate(total):
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(at + (k << bits), pa.int32()), pa.array(row[at])], names=["place", "n"])

    found = docs.select("text").mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(PREFIXES) << bits, np.int64)
    table[found["place"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(len(PREFIXES), -1)


class Plan:
    """Which suffixes go to which group: the prefixes that are too frequent, by length."""

    def __init__(self, counts: np.ndarray, how: Repeats):
        self.how = how
        self.bits = int(counts.shape[1]).bit_length() - 1
        self.groups = max(1, int(-(-counts[0].sum() // how.group_windows)))
        self.frequent = counts > how.group_windows // 8

    def leaves(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, group and label of every suffix."""
        at, h = words.windows(self.how.width)
        group = np.full(len(at), -1, np.int32)
        window = mix64(h)
        label = window >> np.uint64(2 * _ORDER_BITS)
        for k, (n, prefix) in enumerate(zip(PREFIXES, prefix_hashes(words, at), strict=True)):
            place = (prefix >> np.uint64(64 - self.bits)).astype(np.int64)
            mine = (group < 0) & ~self.frequent[k][place]
            group[mine] = mix64(place[mine] + (k << self.bits)) % np.uint64(self.groups)
            if n >= 4:
                label |= (prefix & np.uint64((1 << _ORDER_BITS) - 1)) << np.uint64(64 - _ORDER_BITS * (1 if n == 4 else 2))
        # a whole window has one leaf a block at most, so this splits whatever is left
        rest = group < 0
        group[rest] = mix64(window[rest] + np.uint64(1)) % np.uint64(self.groups)
        return at, group, label


def depth(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Words that two leaves of a group have in common at least, as far as their labels tell: 0, 4, 8 or ``width``."""
    differ = left ^ right
    return np.select([differ == 0, differ < np.uint64(1 << 48), differ < np.uint64(1 << 56)], [width, 8, 4], 0)


class Block:
    """The documents of one block in order of their id, and the leaves of their suffixes in suffix order.

    Texts stay in Arrow and are taken in small pieces; a suffix costs about 60 bytes while it is sorted.
    """

    def __init__(self, table: pa.Table, plan: Plan):
        ids = table["id"].combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        self.order = np.lexsort((ids, null))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[self.order][1:] != ids[self.order][:-1]) | (null[self.order][1:] != null[self.order][:-1])
        rank = (np.cumsum(new) - 1).astype(np.int32)  # equal ids have equal ranks
        self.texts = table["text"].combine_chunks().take(pa.array(self.order))
        at, group, label, doc, counts = [], [], [], [], []
        base = 0
        for a, b in self.pieces():
            words = Words(self.texts[a:b].to_pylist())
            w_at, w_group, w_label = plan.leaves(words)
            at.append((w_at + base).astype(np.int32))
            group.append(w_group)
            label.append(w_label)
            doc.append(rank[a:b][words.doc[w_at]])
            counts.append(words.counts)
            base += len(words.hash)
        empty = np.empty(0, np.int64)
        self.counts = np.concatenate(counts) if counts else empty
        group, label, doc = (np.concatenate(x) if x else empty for x in (group, label, doc))
        by = np.lexsort((doc, label, group))
        self.group, label, self.rank = group[by], label[by], doc[by]
        new = np.ones(len(by), bool)
        new[1:] = (self.group[1:] != self.group[:-1]) | (label[1:] != label[:-1])
        self.first = np.flatnonzero(new).astype(np.int32)  # a node's first leaf, of the smallest id in the block
        self.node = (np.cumsum(new) - 1).astype(np.int32)
        self.label, self.group = label[self.first], self.group[self.first]
        self.at = (np.concatenate(at) if at else empty)[by]

    def pieces(self) -> Iterator[tuple[int, int]]:
        return blocks(pc.fill_null(pc.binary_length(self.texts), 0).to_pylist())

    def _cuts(self) -> np.ndarray:
        g = self.group
        return np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)

    def sent(self, number: int, place: int) -> pa.Table:
        """For each group, the distinct leaves of this block in suffix order."""
        cuts = self._cuts()
        return pa.table({
            "g": pa.array(self.group[cuts[:-1]], pa.int64()), "place": pa.array(np.full(len(cuts) - 1, place), pa.int64()), "block": pa.array(np.full(len(cuts) - 1, number), pa.int64()),
            "leaves": pa.array([self.label[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        })

    def removed(self, answer: pa.Table, width: int) -> np.ndarray:
        """Mask of the words inside a window that starts in a document with a smaller id."""
        earlier = np.zeros(len(self.first), bool)
        bits = dict(zip(answer["g"].to_pylist(), answer["bits"].to_pylist(), strict=True))
        cuts = self._cuts()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if raw := bits.get(int(self.group[a])):
                earlier[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
        bad = earlier[self.node] | (self.rank > self.rank[self.first][self.node]) if len(self.node) else np.empty(0, bool)
        return covered(self.at[bad], width, int(self.counts.sum()))


def _answers(leaves: DataFrame, partitions: int, width: int) -> DataFrame:
    """(block, g, bits): for each leaf a block sent, whether a block of an earlier place sent it too."""

    def run(batches):
        for batch in in_groups(batches, 1):
            g, place, number = (batch.column(i).to_numpy() for i in (0, 1, 2))
            raw = batch.column(3)
            for group in np.unique(g):
                mine = np.flatnonzero(g == group)
                parts = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in mine]
                label = np.concatenate(parts)
                source = np.repeat(place[mine].astype(np.int32), [len(p) for p in parts])
                by = np.lexsort((source, label))
                label, source = label[by], source[by]
                # a deep internal node: leaves that share all words of the window; its first leaf is of the smallest id
                first = np.ones(len(by), bool)
                first[1:] = depth(label[:-1], label[1:], width) < width
                origin = source[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))] if len(by) else source
                again = np.zeros(len(by), bool)
                again[by] = source > origin
                cuts = np.cumsum([0] + [len(p) for p in parts])
                sent = [(int(number[i]), again[a:b]) for i, a, b in zip(mine, cuts[:-1], cuts[1:], strict=True) if again[a:b].any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in sent], pa.int64()), pa.array([int(group)] * len(sent), pa.int64()), pa.array([np.packbits(x).tobytes() for _, x in sent], pa.binary())],
                    names=["block", "g", "bits"],
                )

    dealt = leaves.repartition(partitions, "g").sortWithinPartitions("g", "place", "block")
    return dealt.select("g", "place", "block", "leaves").mapInArrow(run, "block bigint, g bigint, bits binary")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Repeats = Repeats(), keep: tuple[str, ...] = (), with_text: bool = False,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``spans``, and the columns ``keep``.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller
    id; null ids come after all others.  ``spans`` (start, length in words) are the maximal repeats that go.
    The kept words are joined by one space (``kept_text`` if ``with_text``; a text that loses no
    word stays as it is there).

    Null and empty texts have no words; texts of fewer than ``width`` words lose none.  Rows that share an id do
    not remove each other's words, so repeated rows get equal results.  A very long text is a block of its own.
    Columns other than id and text are left alone, whatever their names, and an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{c}") for c in keep])
    ranges = block_ranges(rows, how)
    plan = Plan(prefix_counts(rows, how, how.table_bits(ranges.text_bytes)), how)
    shared = docs.sparkSession.sparkContext.broadcast((ranges, plan))

    @F.pandas_udf(T.LongType())
    def block_of(ids: pd.Series, spread: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        return pd.Series(shared.value[0].block(ids.fillna(0).to_numpy(np.int64), null, spread.to_numpy(np.int64)))

    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    # both passes take the same columns, so that they read one exchange
    dealt = rows.withColumn("block", block_of("id", spread)).repartition(how.partitions(ranges.blocks), "block")

    def send(table: pa.Table) -> pa.Table:
        number = table["block"][0].as_py()
        out = Block(table, shared.value[1]).sent(number, int(shared.value[0].place(np.array(number))))
        pa.default_memory_pool().release_unused()
        return out

    names = [f"_{c}" for c in keep]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)]
        + ([T.StructField("kept_text", T.StringType())] if with_text else []) + [T.StructField(n, kinds[n]) for n in names]
    )

    def settle(table: pa.Table, answer: pa.Table) -> pa.Table:
        block = Block(table, shared.value[1])
        gone = block.removed(answer, how.width)
        order, counts, texts = pa.array(block.order), block.counts, block.texts
        pieces = list(block.pieces())
        del block
        starts = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(gone)])
        lost = total[starts[1:]] - total[starts[:-1]]
        digest, kept_texts, spans = [], [], []
        for a, b in pieces:
            for i, text in enumerate(texts[a:b].to_pylist(), a):
                words, runs = (text or "").encode().split(), []
                if lost[i]:
                    mine = gone[starts[i] : starts[i + 1]]
                    edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).tolist()
                    runs = [{"start": s, "length": e - s} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                    words = [w for w, k in zip(words, mine.tolist(), strict=True) if not k]
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                spans.append(runs)
                if with_text:
                    kept_texts.append(kept.decode() if lost[i] else text)
        out = {
            "id": table["id"].take(order), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        }
        if with_text:
            out["kept_text"] = pa.array(kept_texts, pa.string())
        out = pa.table(out | {n: table[n].take(order) for n in names})
        pa.default_memory_pool().release_unused()
        return out

    answers = _answers(dealt.groupBy("block").applyInArrow(send, "g bigint, place bigint, block bigint, leaves binary"), how.partitions(plan.groups), how.width)
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settle, schema)
    return found.withColumnsRenamed({"id": id_col} | {f"_{c}": c for c in keep})


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """``docs`` with repeated passages cut from the text; a document that loses all its words goes.

    Rows, ids, nulls and ties are treated as in ``remove_repeats``; all columns stay as they are but the text.
    """
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(0).alias("none")]
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*others).alias("row"))
    found = remove_repeats(packed, "id", "text", how, keep=("row",), with_text=True)
    own = {id_col: F.col("id"), text_col: F.col("kept_text")}
    stays = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))
    return found.where(stays).select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
