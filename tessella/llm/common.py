"""Shared helpers of the training-data operators.

Words are maximal runs of characters other than the ASCII white space
``[\\x20\\x09-\\x0D]``; on UTF-8 bytes that is exactly ``bytes.split()``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.batches import in_groups  # noqa: F401  the library's own, for the operators
from tessella.sources.tables import cut, forget  # noqa: F401

#: Characters worked on at once inside a task; keeps the numpy buffers near the cache.
BLOCK_CHARS = 300_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2.  A null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Which bytes are white space, and which continue a character, in UTF-8.
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
CONTINUES = (np.arange(256) & 0xC0) == 0x80
#: A random 64-bit value for each byte and the powers of a random odd number.
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(256, _BYTE[0] | np.uint64(1), np.uint64), dtype=np.uint64)
_ALL = np.arange(256, dtype=np.uint8)
#: Byte tables: A-Z folded; and, besides, every ASCII character but letters a space.
FOLD = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
LETTERS = np.where((FOLD >= 97) & (FOLD <= 122) | (FOLD >= 128), FOLD, 32).astype(np.uint8)


class Words:
    """The words of several texts as flat arrays.

    ``hash`` (64 bits of the word's bytes), ``doc`` (number of its text) and ``chars``
    (its code points) have an entry a word; ``counts`` and ``starts`` one a text.
    Nulls count as empty.  ``table`` (FOLD or LETTERS) is applied to all bytes first.
    """

    def __init__(self, texts: list[str | None], table: np.ndarray | None = None):
        parts = [(t or "").encode() for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        if table is not None:
            raw = table[raw]
        inside = ~SPACE[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.first, self.last = edge[0::2], edge[1::2]  # bytes of each word in ``raw``
        size = self.last - self.first
        at = np.cumsum(size) - size
        packed = raw[inside]
        place = np.arange(len(packed)) - np.repeat(at, size)
        if len(size) and size.max() > len(_POWER):
            place = np.minimum(place, len(_POWER) - 1)
        value = _BYTE[packed]
        value *= _POWER[place]
        if len(at):
            self.hash = mix64(np.add.reduceat(value, at) + size.astype(np.uint64))
            self.chars = np.add.reduceat((~CONTINUES[packed]).astype(np.int64), at)
        else:
            self.hash, self.chars = np.empty(0, np.uint64), np.empty(0, np.int64)
        for i in np.flatnonzero(size > len(_POWER)):
            self.hash[i] = xxhash.xxh3_64_intdigest(raw[self.first[i] : self.last[i]].tobytes())
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.raw = raw
        self.counts = np.diff(np.searchsorted(self.first, ends), prepend=0)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word; 0 for words not longer than that."""
        out = np.zeros(len(self.hash), np.uint64)
        long = np.flatnonzero(self.last - self.first > n)
        h = np.full(len(long), n, np.uint64)
        for k in range(n):
            h += _BYTE[self.raw[self.first[long] + k]] * _POWER[k]
        out[long] = mix64(h)
        return out

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of the n-word windows inside one text, and their hashes."""
        w = window_hashes(self.hash, n)
        at = np.flatnonzero(self.doc[: len(w)] == self.doc[n - 1 :]) if len(w) else np.empty(0, np.int64)
        return at, w[at]


def duplicated(key: np.ndarray) -> np.ndarray:
    """Mask of the entries whose value occurs twice or more."""
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


#: Odd multiplier of the polynomial window hashes.
WINDOW_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries (fewer than ``n``: none)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= WINDOW_BASE
        out += h[k : k + m]
    return out


def covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Mask of positions that lie in ``[s, s + width)`` for some start ``s``."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, length), -1)
    return np.cumsum(edge[:-1]) > 0


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def blocks(sizes: list[int], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``limit``."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
