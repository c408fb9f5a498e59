"""Toxicity by weak supervision.

1. Sixteen voters look at a text: fixed lexicons, patterns, and lexicons of words and word
   stems that are far commoner in toxic labelled rows.  A voter fires or abstains.  A fixed word that
   labelled rows refute, as it is as common in clean ones, leaves its lexicon.
2. Spark counts the vote patterns (at most 2**16) over all documents.  A generative label model
   with a hidden class estimates by EM how often each voter fires in either class (its
   accuracy) and how the voters correlate within a class; correlated votes on one text share their weight.
   A voter that abstains says nothing; that all telling lexicons abstain is a vote of its own.
3. A sparse linear classifier over votes, hashed words and word stems is fitted to the
   label model's posteriors, and to nothing else, of a bounded sample of documents (``max_train`` labelled
   ones, half as many others); observed labels only calibrate its scores by a slope and an intercept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LETTERS, Words, blocks

# Insults by theme, in English, German, French and Spanish.
LEXICONS: dict[str, str] = {
    "intelligence": "idiot moron stupid dumb imbecile fool brainless dimwit idiots morons dumm trottel imbécile crétin débile idiota estúpido imbécil tonto",
    "worth": "worthless loser pathetic useless losers failure wertlos versager nul minable inútil perdedor",
    "contempt": "trash scum garbage filth vermin abschaum müll ordure racaille basura escoria",
    "ridicule": "clown joke laughable buffoon ridiculous lächerlich bouffon payaso ridículo",
    "disgust": "disgusting vile repulsive sickening nasty ekelhaft widerlich dégoûtant asqueroso repugnante",
}
PATTERNS: dict[str, re.Pattern] = {
    "address": re.compile(r"\b(?:you(?:'re| are)? (?:a |an |such )|shut up|go away|du bist|tu es|eres un)", re.I),
    "shouting": re.compile(r"[A-Z]{4,}[!.,]* [A-Z]{3,}"),
    "exclaiming": re.compile(r"!{2,}"),
}
#: Induced voters: words split over four lexicons, stems of three lengths and rare words.
INDUCED = ("words0", "words1", "words2", "words3", "stem4", "stem5", "stem6", "weak")
VOTERS = (*LEXICONS, *PATTERNS, *INDUCED)
STEMS = (4, 5, 6)


@dataclass
class Induced:
    """Hashed words and stems with the voters (bits) that they make fire; sorted by hash."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    bits: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    refuted: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # fixed words that are left out

    def merged(self) -> "Induced":
        gone = set(self.refuted.tolist())
        fixed = [(h, 1 << VOTERS.index(name)) for name, text in LEXICONS.items() for h in Words([text], LETTERS).hash.tolist() if h not in gone]
        new = ~np.isin(self.keys, np.array([k for k, _ in fixed], np.uint64))
        keys = np.concatenate([self.keys[new], np.array([k for k, _ in fixed], np.uint64)])
        bits = np.concatenate([self.bits[new], np.array([b for _, b in fixed], np.int32)])
        keys, at = np.unique(keys, return_inverse=True)
        both = np.zeros(len(keys), np.int32)
        np.bitwise_or.at(both, at, bits)
        return Induced(keys, both)


def features(texts: list[str | None]) -> tuple[Words, list[np.ndarray]]:
    """Folded letter runs of the texts and, per word, its hash and those of its stems (0: none)."""
    words = Words([(t or "").lower() for t in texts], LETTERS)
    return words, [words.hash, *(words.prefix_hashes(k) for k in STEMS)]


def votes(texts: list[str | None], words: Words, kinds: list[np.ndarray], lexicon: Induced) -> np.ndarray:
    """Bit mask of the voters that fire on each text.

    A word counts once: as itself if a lexicon has it, else by its longest listed stem, so
    that voters do not repeat each other.
    """
    out = np.zeros(len(texts), np.int32)
    free = np.ones(len(words.hash), bool)
    for h in (kinds[0], *kinds[:0:-1]) if len(lexicon.keys) else ():
        at = np.minimum(np.searchsorted(lexicon.keys, h), len(lexicon.keys) - 1)
        hit = np.flatnonzero((lexicon.keys[at] == h) & (h != 0) & free)
        np.bitwise_or.at(out, words.doc[hit], lexicon.bits[at[hit]])
        free[hit] = False
    for name, pattern in PATTERNS.items():
        bit = 1 << VOTERS.index(name)
        for i, t in enumerate(texts):
            if t and pattern.search(t):
                out[i] |= bit
    return out


def induce(rows: DataFrame, number: int = 3000, least: int = 4) -> Induced:
    """Words and stems whose document frequency is far higher in the rows with ``y`` 1.

    ``rows`` has ``y`` and ``text``.  Counts are summed per task, then by Spark; at most
    ``number`` entries of the best log odds are kept, the size of the induced lexicons.  Fixed words that
    at least three rows with ``y`` 0 have, and whose odds are not high, are refuted.
    """
    fixed = np.unique(np.concatenate([Words([text], LETTERS).hash for text in LEXICONS.values()])).view(np.int64).tolist()

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            seen = []
            for a, b in blocks([len(t or "") for t in texts]):
                words, kinds = features(texts[a:b])
                for k, h in enumerate(kinds):
                    some = h != 0
                    pair = np.unique(np.rec.fromarrays([words.doc[some], h[some]], names="d,h"))
                    seen.append((np.full(len(pair), k), pair.h, y[a:b][pair.d]))
            kind, h, tox = (np.concatenate(x) for x in zip(*seen, strict=True))
            for k in range(1 + len(STEMS)):
                key, at = np.unique(h[kind == k], return_inverse=True)
                hits = np.bincount(at, weights=tox[kind == k], minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), k), pa.int32()), pa.array(key.view(np.int64)), pa.array(hits), pa.array(np.bincount(at, minlength=len(key)) - hits)],
                    names=["kind", "h", "bad", "good"],
                )

    total = rows.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).first()
    if not total["bad"] or not total["good"]:
        return Induced()
    odds = F.log((F.col("bad") + 0.05) / total["bad"]) - F.log((F.col("good") + 0.05) / total["good"])
    found = (
        rows.select("y", "text").mapInArrow(count, "kind int, h bigint, bad bigint, good bigint")
        .groupBy("kind", "h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .withColumns({"odds": odds, "fixed": (F.col("kind") == 0) & F.col("h").isin(fixed)})
        .where(F.col("fixed") | ((F.col("bad") >= least) & (F.col("odds") > 2.5)))
        .orderBy(F.desc("fixed"), F.desc("odds"), "h", "kind").limit(number + len(fixed)).collect()
    )
    keys, bits, refuted = [], [], []
    for r in found:
        h = r["h"] & (1 << 64) - 1
        if r["fixed"]:
            if r["good"] >= 3 and r["odds"] <= 2.5:
                refuted.append(h)
            continue
        name = f"stem{STEMS[r['kind'] - 1]}" if r["kind"] else f"words{h % 4}"
        keys.append(h)
        bits.append(1 << VOTERS.index(name if r["odds"] > 3.5 else "weak"))
    return Induced(np.array(keys, np.uint64), np.array(bits, np.int32), np.array(refuted, np.uint64))


#: Bits of the voters with a lexicon of telling words; the label model adds a vote of their silence.
LEXICAL = sum(1 << v for v, name in enumerate(VOTERS) if name not in (*PATTERNS, "weak"))


def fired_by(patterns: np.ndarray) -> np.ndarray:
    """Pattern x vote, 0 or 1: the voters, then the silence of all telling lexicons."""
    return np.column_stack([(patterns[:, None] >> np.arange(len(VOTERS))) & 1, (patterns & LEXICAL) == 0]).astype(np.int64)


class LabelModel:
    """Rates at which each vote is cast in either class, correlations within classes, prior."""

    def __init__(self, patterns: np.ndarray, number: np.ndarray, bad: np.ndarray, good: np.ndarray, rounds: int = 50):
        """``number``, ``bad`` and ``good``: documents with each pattern, in all and labelled 1 and 0.

        Labelled rows keep their class in every round, which fixes the meaning of the classes.
        """
        x = fired_by(patterns)
        rates = lambda w0, w1: np.array([((x * w[:, None]).sum(0) + 0.5) / (w.sum() + 5) for w in (w0, w1)])
        if not bad.sum():  # nothing is labelled toxic: a lexicon is taken to be right three times in ten
            bad = number * (x[:, [v for v, name in enumerate(VOTERS) if name not in PATTERNS]].sum(1) > 1) * 0.3
        self.rate = rates(number - bad, bad + 1e-3)
        self.prior = float(np.clip(bad.sum() / max(1.0, bad.sum() + good.sum()), 1e-3, 0.5))
        self.shared = np.zeros((x.shape[1], x.shape[1]))
        self.correlation = np.eye(x.shape[1])
        free = np.maximum(number - bad - good, 0)
        for _ in range(rounds):
            q = self._posterior(x)
            w1, w0 = free * q + bad, free * (1 - q) + good
            self.prior = float(np.clip(w1.sum() / max(1.0, w0.sum() + w1.sum()), 1e-3, 0.5))
            self.rate = rates(w0, w1)
            # what the classes leave unexplained: correlations within a class
            cov = sum(((x - self.rate[c]) * w[:, None]).T @ (x - self.rate[c]) for c, w in ((0, w0), (1, w1)))
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            self.correlation = cov / np.outer(sd, sd)
            self.shared = np.clip(self.correlation - np.eye(x.shape[1]), 0, 1) ** 2

    def _posterior(self, x: np.ndarray) -> np.ndarray:
        r0, r1 = np.clip(self.rate, 1e-4, 1 - 1e-4)
        part = x / (1 + x @ self.shared)  # of each vote, what the other votes cast do not repeat
        z = np.log(self.prior / (1 - self.prior)) + part @ np.log(r1 / r0)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(fired_by(patterns))


#: Columns of the linear classifier: hashed words and stems, then the votes.
HASH_BITS = 18
COLUMNS = (1 << HASH_BITS) + len(VOTERS)


def columns_of(words: Words, kinds: list[np.ndarray], fired: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, column) pairs; only columns with ``keep`` if that is given."""
    doc, col = [], []
    for h in kinds:
        c = (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        some = np.flatnonzero((h != 0) & (keep[c] if keep is not None else True))
        doc.append(words.doc[some])
        col.append(c[some])
    for v in range(len(VOTERS)):
        d = np.flatnonzero(fired >> v & 1)
        doc.append(d)
        col.append(np.full(len(d), (1 << HASH_BITS) + v))
    pair = np.unique(np.concatenate(doc) * COLUMNS + np.concatenate(col))
    return pair // COLUMNS, pair % COLUMNS


def fit_linear(doc: np.ndarray, col: np.ndarray, y: np.ndarray, rounds: int = 600, l1: float = 2e-4) -> np.ndarray:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; last entry: intercept."""
    n = len(y)
    freq = np.bincount(col, minlength=COLUMNS)
    used = np.flatnonzero(freq >= 3)
    back = np.full(COLUMNS, -1)
    back[used] = np.arange(len(used))
    ok = back[col] >= 0
    doc, col = doc[ok], back[col[ok]]
    scale = 1 / np.sqrt(freq[used] + 50.0)  # frequent columns get small steps
    w, b = np.zeros(len(used)), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    past, pb, t = w, b, 1.0
    step = 4.0
    loss_before = np.inf
    for _ in range(rounds):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w + (t - 1) / t2 * (w - past), b + (t - 1) / t2 * (b - pb)
        z = np.bincount(doc, weights=(v * scale)[col], minlength=n) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(np.mean(np.logaddexp(0, z) - y * z))
        g = np.bincount(col, weights=((p - y) / n)[doc], minlength=len(used)) * scale
        past, pb, t = w, b, t2
        if loss > loss_before * 1.05:
            step, t = step / 2, 1.0
        loss_before = loss
        w = v - step * n * g / 50
        w = np.sign(w) * np.maximum(np.abs(w) - step * n * l1 / 50 * scale, 0)
        b = vb - 0.5 * float((p - y).mean())
    out = np.zeros(COLUMNS + 1, np.float32)
    out[used] = w * scale
    out[-1] = b
    return out


def calibration(z: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Slope and intercept for which the scores ``z`` explain the labels best; (1, 0) without both classes."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    x = np.column_stack([z, np.ones(len(z))])
    first = np.array([1.0, 0.0])
    loss = lambda v: float((np.logaddexp(0, x @ v) - y * (x @ v)).sum() + 5e-4 * ((v - first) ** 2).sum())
    v, value = first, loss(first)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - y) + 1e-3 * (v - first))
        for _ in range(30):  # a Newton step may overshoot where the scores are extreme
            new = v - step
            new[0] = np.clip(new[0], 0.1, 10)
            if loss(new) <= value:
                break
            step = step / 2
        else:
            break
        v, value = new, loss(new)
    return float(v[0]), float(v[1])


@dataclass
class ToxicityModel:
    lexicon: Induced
    label_model: LabelModel
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        words, kinds = features(texts)
        fired = votes(texts, words, kinds, self.lexicon)
        doc, col = columns_of(words, kinds, fired, self.weights != 0)
        z = np.bincount(doc, weights=self.weights[col], minlength=len(texts)) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -500, 500)))


def train(docs: DataFrame, sample: DataFrame, eligible: Column, max_train: int = 8_000, text_col: str = "text", id_col: str = "doc_id") -> ToxicityModel | None:
    """Induces lexicons from the labelled ``sample`` (``_id``, ``y``), estimates the label model on
    the votes of all documents and fits the classifier on a sample of ``eligible`` ones.

    None if there are no documents.  Null and empty texts have no votes; texts of any length are read whole.  A
    document's rows are rows of their own, also repeated ones; a null id has no label.  Other columns are
    left alone, whatever their names.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), eligible.alias("_ok"))
    # both samples are bounded by parameters, so their ids can be broadcast
    lexicon = induce(rows.join(F.broadcast(sample), "_id")).merged()
    shared = context.broadcast(lexicon)

    def vote(batches):
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for a, b in blocks([len(t or "") for t in texts]):
                fired = votes(texts[a:b], *features(texts[a:b]), shared.value)
                key, at, n = np.unique(fired, return_inverse=True, return_counts=True)
                bad, good = (np.bincount(at, weights=y[a:b] == c, minlength=len(key)) for c in (1, 0))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(n), pa.array(bad), pa.array(good)], names=["pattern", "n", "bad", "good"])

    found = (
        rows.join(F.broadcast(sample), "_id", "left").select("text", "y").mapInArrow(vote, "pattern int, n bigint, bad double, good double")
        .groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy("pattern").toArrow()
    )
    if not found.num_rows:
        return None
    number = found["n"].to_numpy()
    model = LabelModel(found["pattern"].to_numpy(), number.astype(float), found["bad"].to_numpy(), found["good"].to_numpy())
    known = float((found["bad"].to_numpy() + found["good"].to_numpy()).sum())
    shares = F.when(F.col("y").isNotNull(), F.lit(min(1.0, max_train / max(1.0, known)))).otherwise(F.lit(min(1.0, max_train / 2 / int(number.sum()))))
    model_shared = context.broadcast(model)

    def weak(batches):
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1)
            for a, b in blocks([len(t or "") for t in texts]):
                words, kinds = features(texts[a:b])
                fired = votes(texts[a:b], words, kinds, shared.value)
                q = model_shared.value.posterior(fired)
                doc, col = columns_of(words, kinds, fired)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), y[a:b], pa.array([col[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                    names=["q", "y", "col"],
                )

    bucket = F.pmod(F.xxhash64("_id", F.lit("classifier")), F.lit(1 << 20))
    picked = (
        rows.where("_ok").join(F.broadcast(sample), "_id", "left").where(bucket < shares * (1 << 20)).select("text", "y").mapInArrow(weak, "q double, y double, col binary").toArrow()
    )
    cols = [np.frombuffer(x, np.int32) for x in picked["col"].to_pylist()]
    weights = np.zeros(COLUMNS + 1, np.float32)
    if cols:
        q = picked["q"].to_numpy()
        doc = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
        col = np.concatenate(cols).astype(np.int64)
        weights = fit_linear(doc, col, q)
        y = picked["y"].to_numpy()
        slope, shift = calibration((np.bincount(doc, weights=weights[col], minlength=len(cols)) + weights[-1])[~np.isnan(y)], y[~np.isnan(y)])
        weights *= np.float32(slope)
        weights[-1] += np.float32(shift)
    return ToxicityModel(lexicon, model, weights)


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``score``, the probability that it is toxic.

    Null and empty texts have no words and get the intercept's score; texts of any length are read whole.  Rows are
    independent, so repeated rows get equal scores; other columns are left alone, whatever their names, and an
    empty table gives an empty result.  Without a model all get 0.  The broadcast model has a
    fixed size: 2**18 weights and at most the induced and fixed lexicons.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, out = batch.column(1).to_pylist(), []
            for a, b in blocks([len(t or "") for t in texts]):
                out.append(np.zeros(b - a) if shared.value is None else shared.value.score(texts[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
