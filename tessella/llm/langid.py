"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are Spark aggregates over every eligible document: tasks count
(language, bucket) pairs with ``numpy.bincount`` and Spark adds them up.  The
log-probability matrix has ``buckets x languages`` entries, a size fixed by
parameters and checked before it is broadcast; a batch is a sparse matrix of n-gram
occurrences, multiplied with it by gathering rows and adding them up per document.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blocks

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")


@functools.cache
def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter of the BMP, a space for the rest."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and _LETTER.match(chr(c)):
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each with a leading and a final space; starts."""
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in texts])
    table = _letter_table()
    return np.where(raw < 0x10000, table[np.minimum(raw, 0xFFFF)], raw), np.concatenate([[0], ends])


def ngrams(texts: list[str], orders: tuple[int, ...], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the text number and the hashed bucket of every n-gram, in text order.

    Runs of other characters count as one space; n-grams with an inner space are left out.
    """
    points, starts = _code_points(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    space = points == 32
    keep = ~space
    keep[:1] = True  # the first text of a batch begins like the others
    keep[1:] |= ~space[:-1] | (doc[1:] != doc[:-1])
    points, doc, space = points[keep], doc[keep], space[keep]
    out = []
    for n in orders:
        m = max(0, len(points) - n + 1)
        ok = doc[:m] == doc[n - 1 :][:m]
        for k in range(1, n - 1) if n > 1 else range(1):
            ok &= ~space[k : k + m]
        h = points[:m] + np.uint32(n)
        for k in range(1, n):
            h *= np.uint32(0x01000193)
            h += points[k : k + m]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - bits)
        out.append((doc[:m][ok], h[ok]))
    return out


#: Languages that a task counts at once; with more it gives out what it has and begins anew.
_LANGUAGES_A_TASK = 64


class LanguageModel:
    """Names, log priors and a ``(2**bits, languages)`` float32 log-probability matrix."""

    def __init__(self, names: list[str], prior: np.ndarray, logp: np.ndarray, orders: tuple[int, ...], bits: int):
        self.names, self.prior, self.logp, self.orders, self.bits = names, prior, logp, orders, bits

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Most probable language and its tempered posterior for each text."""
        total = np.zeros((len(texts), len(self.names)))
        mass = np.zeros(len(texts))
        step = max(1, 4_000_000 // max(1, len(self.names)))
        for doc, bucket in ngrams(texts, self.orders, self.bits):
            mass += np.bincount(doc, minlength=len(texts))
            for a in range(0, len(doc), step):
                d = doc[a : a + step]
                at = np.flatnonzero(np.diff(d, prepend=-1))
                total[d[at]] += np.add.reduceat(self.logp[bucket[a : a + step]], at, axis=0)
        # n-grams overlap, so the evidence is damped to its square root in length
        z = total / np.sqrt(np.maximum(mass, 1))[:, None] + self.prior
        best = np.argmax(total + self.prior, axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [self.names[b] for b in best], p[np.arange(len(texts)), best]


def train(
    docs: DataFrame, text: str, lang: str, eligible: Column, orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 15, smoothing: float = 0.1, max_languages: int = 1024,
) -> LanguageModel | None:
    """Count n-grams of every eligible row with a text and a language.

    None if there is no such row.  Texts of any length are read whole, empty ones add only to their language's
    prior, and repeated rows count as often as they are there; other columns are left alone.  More than ``max_languages`` languages raise, since the
    matrix would no longer be of a proven size.
    """
    rows = docs.where(eligible & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        number: Counter[str] = Counter()

        def counted():
            none = np.zeros(1, np.int64)
            for name in number:
                acc = sums.get(name, none)
                at = np.flatnonzero(acc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()),
                     pa.array(np.append(acc[at], number[name]))],
                    names=["lang", "bucket", "n"],
                )
            sums.clear()
            number.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks([len(t) for t in texts]):
                names, own = np.unique(np.array(langs[a:b], dtype=object), return_inverse=True)
                for doc, bucket in ngrams(texts[a:b], orders, bits):
                    code, n = np.unique((own[doc] << bits) | bucket.astype(np.int64), return_counts=True)
                    if len(names) > _LANGUAGES_A_TASK:  # too many for an array each
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[code >> bits].tolist(), pa.string()), pa.array(code & ((1 << bits) - 1), pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"]
                        )
                        continue
                    for k, at in zip(*np.unique(code >> bits, return_index=True), strict=True):
                        mine = slice(at, np.searchsorted(code, (k + 1) << bits))
                        sums.setdefault(names[k], np.zeros(1 << bits, np.int64))[code[mine] & ((1 << bits) - 1)] += n[mine]
                number.update(langs[a:b])
                if max(len(sums), len(number)) > _LANGUAGES_A_TASK:
                    yield from counted()
        yield from counted()

    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(max_languages + 1).toArrow()
    if packed.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not packed.num_rows:
        return None
    order = np.argsort(np.array(packed["lang"].to_pylist(), dtype=object))
    names, prior, logp = [], [], []
    for i in order:
        flat = packed["c"].combine_chunks()[int(i)].values
        bucket, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        row = np.full(1 << bits, smoothing)
        row[bucket[bucket >= 0]] += n[bucket >= 0]
        names.append(packed["lang"][int(i)].as_py())
        prior.append(float(n[bucket < 0].sum()))
        logp.append(np.log(row / row.sum()))
    return LanguageModel(names, np.log(np.array(prior) / sum(prior)), np.array(logp, np.float32).T.copy(), orders, bits)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``.

    ``und`` with score 0 if the text is null, empty or has no letter, or nothing was learned.  Of equally probable
    languages the first by name is taken.  Texts of any length are read whole.  Rows are independent, so
    repeated rows get equal results; other columns are left alone, whatever their names, and an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if m is not None:
                for a, b in blocks([len(t) for t in texts]):
                    best, p = m.score(texts[a:b])
                    for i, (name, q) in enumerate(zip(best, p, strict=True), a):
                        if _LETTER.search(texts[i]):
                            names[i], scores[i] = name, q
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double"
    ).withColumnRenamed("id", id_col)
