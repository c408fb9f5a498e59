"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths (numpy, within one document) mark the
characters that lie inside n-grams of words, n-grams of marks (characters that are neither letters nor
numbers) or lines seen more than once in the text.
The map is narrow: no shuffle, one pass over the texts.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Words, blocks, covered, duplicated, mix64

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class RepetitionRules:
    """Verdict thresholds: the largest share of word characters inside repeated n-grams, by
    n, of characters inside repeated runs of ``mark_window`` marks, and of characters and lines that repeat an earlier line.

    Chosen on the labelled rows of sf0.1 outside the held-out part, just above the good ones' largest values.
    """

    ngram_shares: tuple[tuple[int, float], ...] = ((5, 0.30), (8, 0.30), (13, 0.25))
    mark_window: int = 3
    mark_share: float = 0.10
    line_share: float = 0.50
    line_char_share: float = 0.40
    repeat_window: int = 8
    min_words: int = 20


FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("max_ngram_share", pa.float64()),
    ("dup_line_chars", pa.int64()), ("mark_chars", pa.int64()), ("kept", pa.bool_()),
)


def repeated_words(words: Words, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each n: mask of the words inside an n-word window that its text has twice or more.

    A window can repeat only where its shorter prefix does, so longer windows look
    only at the places that the next shorter ones left.
    """
    out, live = {}, None
    salt = mix64(np.arange(len(words.counts)))
    for n in sorted(sizes):
        at, w = words.windows(n)
        if live is not None:
            keep = live[at]
            at, w = at[keep], w[keep]
        at = at[duplicated(w ^ salt[words.doc[at]])]
        out[n] = covered(at, n, len(words.hash))
        live = np.zeros(len(words.hash), bool)
        live[at] = True
    return out


@functools.cache
def _marks() -> np.ndarray:
    """Which code points of the BMP are neither letters nor numbers."""
    text = "".join(map(chr, range(0xD800))) + "a" * 0x800 + "".join(map(chr, range(0xE000, 0x10000)))
    table = np.zeros(0x10000, bool)
    table[[m.start() for m in regex.finditer(r"[^\p{L}\p{N}]", text)]] = True
    return table


def repeated_marks(texts: list[str], n: int) -> np.ndarray:
    """For each text, its characters inside runs of ``n`` marks, not all white space, that it has twice or more."""
    points = np.frombuffer("".join(t + "a" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = _marks()[np.minimum(points, 0xFFFF)] & (points < 0x10000)
    for c in np.unique(points[points >= 0x10000]).tolist():
        mark[points == c] = not regex.match(r"[\p{L}\p{N}]", chr(c))
    blank = np.isin(points, [ord(c) for c in _BLANK])
    m = max(0, len(points) - n + 1)
    run, empty, key = np.ones(m, bool), np.ones(m, bool), np.zeros(m, np.uint64)
    for k in range(n):
        run &= mark[k : k + m]
        empty &= blank[k : k + m]
    at = np.flatnonzero(run & ~empty)
    for k in range(n):
        key = mix64((key[: len(at)] << np.uint64(21)) + points[at + k]) if k else points[at].astype(np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, at, side="right")
    at = at[duplicated(mix64(key) ^ mix64(doc))] if len(at) else at
    inside = np.append(0, np.cumsum(covered(at, n, len(points))))
    return np.diff(inside[np.append(0, ends)])


def measure(texts: list[str | None], rules: RepetitionRules = RepetitionRules()) -> list[tuple]:
    """The values of FIELDS for each whole text (null: no words)."""
    texts = [t or "" for t in texts]
    words = Words(texts)
    chars = words.chars
    sizes = [n for n, _ in rules.ngram_shares]
    found = repeated_words(words, [*sizes, rules.repeat_window])
    per_text = lambda v: np.bincount(words.doc, weights=v, minlength=len(texts)).astype(np.int64)
    total, repeat = per_text(chars), per_text(found[rules.repeat_window])
    shares = {n: per_text(chars * found[n]) / np.maximum(total, 1) for n in sizes}
    marks = repeated_marks(texts, rules.mark_window)
    out = []
    for i, text in enumerate(texts):
        n = int(words.counts[i])
        lines = [x for x in text.split("\n") if x.strip(_BLANK)]
        seen: set[str] = set()
        dup_lines = dup_chars = 0
        for x in lines:
            if x in seen:
                dup_lines += 1
                dup_chars += len(x)
            seen.add(x)
        failed = n < rules.min_words or 100 * int(repeat[i]) > 30 * n
        bad = failed or any(shares[k][i] > most for k, most in rules.ngram_shares)
        bad = bad or dup_lines > rules.line_share * len(lines) or dup_chars > rules.line_char_share * len(text)
        bad = bad or int(marks[i]) > rules.mark_share * len(text)
        out.append((n, int(total[i]), sum(map(text.count, SYMBOLS)), dup_lines, int(repeat[i]), failed,
                    float(max(shares[k][i] for k in sizes)), dup_chars, int(marks[i]), not bad))
    return out


def measured(docs: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules(), prefix: str = "") -> DataFrame:
    """``docs`` with all its columns and the measures of FIELDS, named with ``prefix``.

    Null and empty texts have no words and fail the base rule; texts of any length are read whole.  Every
    row is judged alone, so repeated rows get equal results; an empty table gives an empty result.  Columns of
    the measures' names must not clash: ``quality_rules`` and ``keep_good`` take care of that.
    """
    schema = T.StructType(docs.schema.fields + _spark_fields(prefix))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            rows = []
            for a, b in blocks([len(t or "") for t in texts]):
                rows += measure(texts[a:b], rules)
            found = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
            arrays = [pa.array(list(v), kind) for v, (_, kind) in zip(found, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, names=batch.schema.names + [prefix + f for f, _ in FIELDS])

    return docs.mapInArrow(run, schema)


def _spark_fields(prefix: str) -> list[T.StructField]:
    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}
    return [T.StructField(prefix + name, kinds[kind]) for name, kind in FIELDS]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """Per row: id and the measures, ``base_failed`` and ``kept``; as ``measured``, whatever other columns there are."""
    return measured(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", rules).drop("_text")


def keep_good(docs: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns, whatever their names."""
    prefix = "_rule_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return measured(docs, text_col, rules, prefix).where(f"{prefix}kept").select(*docs.columns)
