"""Alignment of two tokenizers over the same bytes, and how often their tokens are linked.

Both tokenizations of a text end tokens at byte offsets.  Where tokens of both end, a group ends; all tokens of one side are
linked with all of the other side inside a group.  The places are found by intersecting the keys of two dictionaries from
an end to the token's number; the sorted common ends slice both id lists.

Corpus-wide counts are kept small: a task works on blocks of documents and gives a block's distinct linked pairs with the
number of its documents that hold them.  These rows, at most one a pair and block, are the pre-aggregate of the counts and at the same time
the request for them, so no pair is a hot key, and a block gets back just what its documents need.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import Codec
from tessella.llm.common import blocks, cut

#: Largest tokenizer files that are sent to the tasks.
FILE_LIMIT = 64 << 20
#: Characters encoded at once, and of a block of documents (a longer document is a block of its own).
BATCH_CHARS, BLOCK_CHARS = 400_000, 4_000_000
#: Bytes whose ends are in the dictionaries at once, and most links that are spread out at once.
WINDOW, LINKS = 1 << 20, 1 << 21


def _file(path: str) -> bytes:
    if os.path.getsize(path) > FILE_LIMIT:
        raise ValueError(f"{path} is larger than {FILE_LIMIT} bytes")
    with open(path, "rb") as f:
        return f.read()


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer of the ``tokenizers`` library's JSON form, its special tokens left out.

    Where ids are the order of merges and the splitting is the common one, the same merges are done by
    tiktoken, which is several times faster; other files are run by ``tokenizers`` itself.
    """

    def __init__(self, source: bytes, pattern: str, fast: bool = True):
        made = json.loads(source)
        model = made["model"]
        byte = byte_of_char()
        special = {t["content"] for t in made["added_tokens"]}
        vocabulary = {bytes(byte[c] for c in entry): i for entry, i in model["vocab"].items() if entry not in special}
        self.size = 1 + max(vocabulary.values())
        self.bytes = [b""] * self.size
        for token, i in vocabulary.items():
            self.bytes[i] = token
        self._fast = self._slow = None
        if fast and self._in_merge_order(made, vocabulary, byte):
            self._fast = Codec(vocabulary, pattern)
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._slow = Tokenizer.from_str(source.decode())
            self._slow.encode_special_tokens = True

    @staticmethod
    def _in_merge_order(made: dict, vocabulary: dict[bytes, int], byte: dict[str, int]) -> bool:
        split = made["pre_tokenizer"] or {}
        plain = (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True), made["normalizer"], made["model"].get("dropout"))
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        joined = [bytes(byte[c] for c in a + b) for a, b in merges]
        ids = [vocabulary.get(t) for t in joined]
        single = {bytes([b]) for b in range(256)}
        return plain == ("ByteLevel", False, True, None, None) and None not in ids and ids == sorted(ids) and len(set(joined)) == len(joined) and set(vocabulary) == single | set(joined)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self._fast is not None:
            return [self._fast.encode(t) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self._slow.encode_batch(texts, add_special_tokens=False)]


class PieceBpe:
    """A sentencepiece model; its pieces as bytes, U+2581 as a space and ``<0xHH>`` as a byte."""

    def __init__(self, source: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.size = self._model.get_piece_size()
        self.bytes = [self._piece(i) for i in range(self.size)]

    def _piece(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        if self._model.is_byte(i):
            return bytes([int(re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self._model.encode(texts, out_type=int, num_threads=1)]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every offset where tokens of both sides end: how many tokens of each side end up to there.

    The last ends must be equal.  Dictionaries hold a window of offsets, which grows where it holds no common end.
    """
    out_a, out_b, i, j, size = [], [], 0, 0, window
    while i < len(ends_a):
        limit = (int(ends_a[i - 1]) if i else 0) + size
        i2, j2 = int(np.searchsorted(ends_a, limit, "right")), int(np.searchsorted(ends_b, limit, "right"))
        at_a = dict(zip(ends_a[i:i2].tolist(), range(i + 1, i2 + 1), strict=True))
        at_b = dict(zip(ends_b[j:j2].tolist(), range(j + 1, j2 + 1), strict=True))
        both = sorted(at_a.keys() & at_b.keys())
        if not both:
            size *= 2
            continue
        out_a.append(np.fromiter(map(at_a.__getitem__, both), np.int64, len(both)))
        out_b.append(np.fromiter(map(at_b.__getitem__, both), np.int64, len(both)))
        i, j, size = int(out_a[-1][-1]), int(out_b[-1][-1]), window
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


@dataclass
class Aligned:
    """Several texts' ids, joined, and the places where texts (``doc_*``) and groups (``stop_*``) end in them."""

    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    stop_a: np.ndarray
    stop_b: np.ndarray

    @property
    def doc_groups(self) -> np.ndarray:
        return np.searchsorted(self.stop_a, self.doc_a, "right")


class Aligner:
    def __init__(self, byte_json: bytes, piece_model: bytes, pattern: str):
        self.a, self.b = ByteBpe(byte_json, pattern), PieceBpe(piece_model)
        self._len_a, self._len_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        width = len(str(max(self.a.size, self.b.size)))
        number = np.arange(max(self.a.size, self.b.size))
        digits = np.stack([number // 10**k % 10 for k in range(width - 1, -1, -1)], axis=1)
        shown = np.stack([number >= 10**k for k in range(width - 1, 0, -1)] + [number >= 0], axis=1)
        self._digits = np.hstack([digits + 48, np.zeros((len(number), 1))]).astype(np.uint8)
        self._shown = np.hstack([shown, np.ones((len(number), 1), bool)])

    def align(self, texts: list[str | None]) -> Aligned:
        """Both tokenizations of texts; a text that is null, empty or not rebuilt by both has no tokens."""
        at = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in at]
        ids_a, ids_b = self.a.encode(spaced), self.b.encode([texts[i] for i in at])
        n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        kept_a, kept_b = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
        for i, text, x, y in zip(at, spaced, ids_a, ids_b, strict=True):
            raw = text.encode()
            if b"".join(map(self.a.bytes.__getitem__, x.tolist())) == raw and b"".join(map(self.b.bytes.__getitem__, y.tolist())) == raw:
                n_a[i], n_b[i] = len(x), len(y)
                kept_a.append(x)
                kept_b.append(y)
        a, b = np.concatenate(kept_a).astype(np.int64), np.concatenate(kept_b).astype(np.int64)
        # texts are aligned together: both sides of each end at its last byte, so no group holds tokens of two
        stops = common_ends(np.cumsum(self._len_a[a]), np.cumsum(self._len_b[b]))
        return Aligned(a, b, np.cumsum(n_a), np.cumsum(n_b), *stops)

    def written(self, x: Aligned) -> list[str]:
        """Digest of each text's groups in the form ``a1,a2|b1;a3|b2,b3``; empty for a text without tokens."""
        before_a, before_b = np.append(0, x.stop_a[:-1]), np.append(0, x.stop_b[:-1])
        group_a, group_b = (np.repeat(np.arange(len(s)), s - p) for s, p in ((x.stop_a, before_a), (x.stop_b, before_b)))
        n = len(x.a) + len(x.b)
        ids, sep = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[np.arange(len(x.a)) + before_b[group_a]] = x.a
        ids[np.arange(len(x.b)) + x.stop_a[group_b]] = x.b
        sep[x.stop_a + before_b - 1] = ord("|")
        sep[x.stop_a + x.stop_b - 1] = ord(";")
        rows, shown = self._digits[ids], self._shown[ids]
        rows[:, -1] = sep
        size = np.append(0, np.cumsum(shown.sum(axis=1)))
        text = rows[shown]
        ends = size[x.doc_a + x.doc_b]
        out, start = [], 0
        for end in ends.tolist():
            out.append(hashlib.sha256(text[start : end - 1].tobytes()).hexdigest() if end > start else "")
            start = end
        return out

    def pairs(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, a * |B| + b, links)``: the different linked id pairs of each text, with their number of links."""
        before_a, before_b = np.append(0, x.stop_a[:-1]), np.append(0, x.stop_b[:-1])
        n_a, n_b = x.stop_a - before_a, x.stop_b - before_b
        doc = np.searchsorted(x.doc_a, x.stop_a, "left")
        links = n_a * n_b
        per_doc = self.a.size * self.b.size
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]

        def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            return keys[first], np.add.reduceat(counts, first) if len(first) else counts

        usual = np.flatnonzero(links <= LINKS)
        sums = np.cumsum(links[usual])
        for lo, hi in _runs(sums, LINKS):
            g = usual[lo:hi]
            m = links[g]
            at = np.repeat(np.arange(len(g)), m)
            place = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            i, j = before_a[g][at] + place // n_b[g][at], before_b[g][at] + place % n_b[g][at]
            found.append(np.unique(doc[g][at] * per_doc + x.a[i] * self.b.size + x.b[j], return_counts=True))
        for g in np.flatnonzero(links > LINKS):
            # a long group without a common end: its different ids, times each other
            ids_a, times_a = np.unique(x.a[before_a[g] : x.stop_a[g]], return_counts=True)
            ids_b, times_b = np.unique(x.b[before_b[g] : x.stop_b[g]], return_counts=True)
            found.append(((doc[g] * per_doc + ids_a[:, None] * self.b.size + ids_b).ravel(), (times_a[:, None] * times_b).ravel()))
        keys, counts = found[-1] if len(found) == 2 else merged(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return keys // per_doc, keys % per_doc, counts


def _runs(sums: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of entries whose running sums ``sums`` grow by at most ``limit`` (one entry at least)."""
    at = 0
    while at < len(sums):
        before = int(sums[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sums, before + limit, "right")))
        yield at, end
        at = end


def align_documents(docs: DataFrame, byte_json: str, piece_model: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the ids ``a`` and ``b`` of both tokenizers and, for each group, where it stops in them (``stop_a``, ``stop_b``).

    A text that is null or empty, or that the joined bytes of either side do not rebuild (after a space), has empty
    arrays.  Rows are independent: repeated rows get equal results; an empty table gives an empty one; other columns are left alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_file(byte_json), _file(piece_model)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in blocks([len(t or "") for t in texts], BATCH_CHARS):
                x = aligner.align(texts[lo:hi])
                groups = x.doc_groups
                columns = []
                for values, ends, shift in ((x.a, x.doc_a, None), (x.b, x.doc_b, None), (x.stop_a, groups, x.doc_a), (x.stop_b, groups, x.doc_b)):
                    starts = np.append(0, ends)
                    if shift is not None:  # stops are counted from their own text's first token
                        values = values - np.repeat(np.append(0, shift[:-1]), np.diff(starts))
                    columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=["id", "a", "b", "stop_a", "stop_b"])

    arrays = "a array<int>, b array<int>, stop_a array<int>, stop_b array<int>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {arrays}").withColumnRenamed("id", id_col)


#: Bits of a block's number inside its partition.
_BLOCK_BITS = 33
_DOC = "n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, sha array<string>, pairs array<int>, place array<int>, links array<bigint>, key array<bigint>, docs array<int>"


def _blocks_of(docs: DataFrame, shared, pattern: str, kind: str, block_chars: int) -> DataFrame:
    """One row a block of documents: their figures, their pairs (``place`` in the block's sorted ``key``) and how many of them hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value, pattern)
        number = TaskContext.get().partitionId() << _BLOCK_BITS
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size = [len(t or "") for t in texts]
            for start, stop in blocks(size, block_chars):
                n_a, n_b, n_groups, sha, counts, keys, links = [], [], [], [], [], [], []
                for lo, hi in blocks(size[start:stop], BATCH_CHARS):
                    x = aligner.align(texts[start + lo : start + hi])
                    doc, key, times = aligner.pairs(x)
                    n_a.append(np.diff(x.doc_a, prepend=0))
                    n_b.append(np.diff(x.doc_b, prepend=0))
                    n_groups.append(np.diff(x.doc_groups, prepend=0))
                    sha += aligner.written(x)
                    counts.append(np.bincount(doc, minlength=hi - lo))
                    keys.append(key)
                    links.append(times)
                known, place = np.unique(np.concatenate(keys), return_inverse=True)
                held = np.bincount(place, minlength=len(known))
                one = lambda v, t: pa.array([v], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), batch.column(0).slice(start, stop - start)),
                        *[one(np.concatenate(v), pa.int64()) for v in (n_a, n_b, n_groups)], one(sha, pa.string()), one(np.concatenate(counts), pa.int32()),
                        one(place, pa.int32()), one(np.concatenate(links), pa.int64()), one(known, pa.int64()), one(held, pa.int32()),
                    ],
                    names=["block", "id", "n_a", "n_b", "n_groups", "sha", "pairs", "place", "links", "key", "docs"],
                )
                number += 1

    return docs.mapInArrow(run, f"block bigint, id array<{kind}>, {_DOC}")


def link_statistics(docs: DataFrame, byte_json: str, piece_model: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    An id pair's count is the number of documents that hold it linked; ``count_sum`` adds it up over a document's links, and
    ``n_best`` are the links whose count is the highest of their first id.  Texts without tokens (see ``align_documents``) have
    zeros and an empty digest.  Each row of the table is a document, also where ids are null or repeat; an empty table gives an empty one;
    other columns are left alone, whatever their names.

    A block's pairs come back to it in one group; there are at most as many as its texts have links.  The highest
    counts, one a token of the first vocabulary, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_file(byte_json), _file(piece_model)))
    kind = docs.schema[id_col].dataType.simpleString()
    n_b = PieceBpe(shared.value[1]).size
    # written once: encoding is not repeated, and blocks keep their numbers when an executor is lost
    made = cut(_blocks_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shared, pattern, kind, block_chars))
    held = made.select("block", F.explode(F.arrays_zip("key", "docs")).alias("x")).select("block", "x.key", "x.docs")
    counted = held.withColumn("n", F.sum("docs").over(Window.partitionBy("key"))).select("block", "key", "n")
    first = F.floor(F.col("key") / n_b)
    best = counted.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # at most one row a token of A
    known = counted.join(F.broadcast(best), first == F.col("a")).select(F.col("block").alias("for_block"), "key", "n", (F.col("n") == F.col("most")).alias("best"))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("key").to_numpy())
        n, top = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        of = lambda c: left.column(c).combine_chunks().flatten()
        place, links, pairs = (of(c).to_numpy() for c in ("place", "links", "pairs"))
        ends = np.cumsum(pairs)
        total = lambda v: np.diff(np.append(0, np.append(0, np.cumsum(v))[ends]))
        figures = (total(links), total(links * top[place]), total(links * n[place])) if len(n) else (np.zeros(len(pairs), np.int64),) * 3
        return pa.table([of("id"), of("n_a"), of("n_b"), of("n_groups"), *[pa.array(f, pa.int64()) for f in figures], of("sha")], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    columns = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    joined = made.drop("key", "docs").groupBy("block").cogroup(known.groupBy("for_block")).applyInArrow(finish, columns)
    return joined.withColumnRenamed("id", id_col)
