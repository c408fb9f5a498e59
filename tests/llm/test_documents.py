"""Operators on documents against plain Python."""

import hashlib
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plain import WORD, components, fold, plain_targets, prose, repeats, shingles, without_repeats
from tessella.llm import bpe, langid, minhash, mixing, quality, repetition, substrings, toxicity
from tessella.llm.common import FOLD, LETTERS, Words, is_held_out



@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40)), min_size=1, max_size=6))
def test_words(texts):
    w = Words(texts)
    own = [WORD.findall(t or "") for t in texts]
    assert w.counts.tolist() == [len(x) for x in own]
    assert w.chars.tolist() == [len(x) for t in own for x in t]
    flat = [x for t in own for x in t]
    assert len(set(w.hash.tolist())) == len(set(flat))
    assert Words(texts, FOLD).hash.tolist() == Words([fold(t or "") for t in texts]).hash.tolist()
    assert Words(["Ab9c!d"], LETTERS).counts.tolist() == [3]


def test_quality_rules(docs, no_docs):
    found = [r for r in repetition.quality_rules(docs).collect()]
    assert len(found) == docs.count()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    expected = Counter()
    for (i, t), k in texts.items():
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = sum(repeats(words, 8))
        bad = len(words) < 20 or 100 * rep > 30 * len(words)
        expected[(i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, bad)] += k
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == expected
    assert not any(r.kept and r.base_failed for r in found)
    shares = {r.doc_id: r.max_ngram_share for r in found}
    words = WORD.findall(dict(texts.keys())[51])
    chars = [len(w) for w in words]
    assert shares[51] == pytest.approx(sum(c for c, m in zip(chars, repeats(words, 5)) if m) / sum(chars))
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)
    assert repetition.quality_rules(no_docs).count() == 0


def plain_marks(t):
    """Characters inside three marks in a row, not all blank, that the text has twice or more."""
    mark = [not (c.isalpha() or c.isnumeric()) for c in t]
    at = [i for i in range(len(t) - 2) if all(mark[i : i + 3]) and t[i : i + 3].strip(" \t\n\r\x0b\x0c")]
    seen = Counter(t[i : i + 3] for i in at)
    return len({i + k for i in at if seen[t[i : i + 3]] > 1 for k in range(3)})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \n|$%#.é漢\U0001f600", max_size=40), min_size=1, max_size=5))
def test_repeated_marks(texts):
    assert repetition.repeated_marks(texts, 3).tolist() == [plain_marks(t) for t in texts]


def test_verdict_is_more_than_the_base_rule():
    clean, junk, rows = prose(1, 200), " ".join(f"{w}$$$" for w in prose(2, 100).split()), " | ".join(prose(3, 100).split())
    looped = " ".join(prose(4 + k, 6) for k in [*range(40), *(7 * k % 40 for k in range(40))])  # five-word runs that come back, never eight
    for text, kept in ((clean, True), (junk, False), (rows, False), (looped, False), (f"{clean} {clean[:60]}", True)):
        found = dict(zip([f for f, _ in repetition.FIELDS], repetition.measure([text])[0], strict=True))
        assert not found["base_failed"] and found["kept"] == kept and found["mark_chars"] == plain_marks(text)


def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe(docs, no_docs):
    path, pattern = ranks()
    codec = bpe.Codec(bpe.load_ranks(path), pattern)
    out = bpe.encode_documents(docs, path, pattern)
    have = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = Counter()
    for r in docs.collect():
        ids = codec.encoding.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert have == want
    back = bpe.decode_documents(out, path, pattern).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert bpe.encode_documents(no_docs, path, pattern).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab é'sT9 \n !漢", max_size=400))
def test_bpe_parts(text):
    path, pattern = ranks()
    codec = test_bpe_parts.__dict__.setdefault("codec", bpe.Codec(bpe.load_ranks(path), pattern))
    cut = [i for p in bpe.parts(text, 5) for i in codec.encoding.encode_ordinary(p)]
    assert "".join(bpe.parts(text, 5)) == text and cut == codec.encoding.encode_ordinary(text)


def test_near_duplicates(docs, no_docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    named = [(i, s) for i, s in rows if i is not None]
    links = [(a, b) for a, x in named for b, y in named if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = components({i for i, _ in named}, links)
    found = minhash.near_duplicates(docs, forest=minhash.Forest(shingle=4)).collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r.n_shingles) for r in found) == Counter((i, len(s)) for i, s in rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id == (want[3] if r.n_shingles else None) and not r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)
    stay = minhash.representatives(docs, forest=minhash.Forest(shingle=4))
    ids = [r.doc_id for r in stay.collect()]
    assert stay.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted([i for i in want if want[i] == i] + [10]) and ids.count(None) == 2  # 10 has two texts
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.representatives(no_docs).count() == 0


@pytest.mark.parametrize("chunk, block_bytes", [(1024, 8 << 20), (100, 100_000)])
def test_large_family(spark, chunk, block_bytes):
    """A hub with many copies that are often too far from each other, and some too far from the hub."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [base]
    for _ in range(420):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        texts.append(t)
    rows = [(1000 - k, " ".join(t)) for k, t in enumerate(texts)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(set(sets), links)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), forest=minhash.Forest(shingle=4, chunk=chunk, block_bytes=block_bytes))
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_parts_of_a_sorted_order():
    rng = np.random.default_rng(4)
    sig = np.unique(rng.integers(0, 3, (400, 12)), axis=0)
    lcp = np.append(0, [next(k for k in range(13) if k == 12 or a[k] != b[k]) for a, b in zip(sig, sig[1:])])
    part = minhash.prefix_parts(lcp, 16, 1, 12)
    assert np.bincount(part).max() <= 16 and (np.diff(part) >= 0).all()
    for x in range(part[-1]):  # two neighbours are parted only where their parent part was too large
        k = int(np.flatnonzero(part == x)[-1])
        assert (sig[:, : lcp[k + 1]] == sig[k, : lcp[k + 1]]).all(axis=1).sum() > 16 or lcp[k + 1] == 0
    assert minhash.prefix_parts(np.array([0] + [12] * 30), 16, 1, 12).tolist() == [0] * 31  # equal signatures stay together


@pytest.mark.parametrize("how", [substrings.Repeats(), substrings.Repeats(block_bytes=3000, group_windows=500)])
def test_substrings(docs, no_docs, how):
    found = substrings.remove_repeats(docs, how=how).collect()
    assert Counter(tuple(r)[:4] for r in found) == Counter(without_repeats([(r.doc_id, r.text) for r in docs.collect()]))
    assert all(sum(s.length for s in r.spans) == r.n_removed and all(s.length > 0 for s in r.spans) for r in found)
    kept = substrings.deduplicated(docs, how=how)
    gone = sum(n and n == k for _, n, k, _ in without_repeats([(r.doc_id, r.text) for r in docs.collect()]))
    assert kept.columns == docs.columns and kept.count() == docs.count() - gone
    assert substrings.remove_repeats(no_docs, how=how).count() == 0 and substrings.deduplicated(no_docs).count() == 0


def test_hot_ids_have_several_blocks(spark):
    """Half of all rows share an id, others have none, and passages run through all of them."""
    passage = "a passage that very many of the documents have in common with each other and that goes on"
    rows = [(7 if i % 2 else None if i % 3 == 0 else i, f"{prose(i, 30)} {passage} {prose(i % 5, 20)}") for i in range(200)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    how = substrings.Repeats(block_bytes=2000, group_windows=300)
    ranges = substrings.block_ranges(df.withColumnRenamed("doc_id", "id"), how)
    of = ranges.block(np.full(50, 7), np.zeros(50, bool), np.arange(50) * 7919)
    assert len(set(of.tolist())) > 5 and len(set(ranges.place(of).tolist())) == 1
    assert len(set(ranges.block(np.zeros(50, int), np.ones(50, bool), np.arange(50)).tolist())) > 2
    have = Counter(tuple(r)[:4] for r in substrings.remove_repeats(df, how=how).collect())
    assert have == Counter(without_repeats(rows))


def test_blocks_hold_equal_text(spark, no_docs):
    how = substrings.Repeats(block_bytes=1000, most_partitions=3)
    sizes = [(i, 10 if i % 100 else 5000) for i in range(1000)] + [(77, 30), (None, 40)]
    rows = spark.createDataFrame([(i, "x" * n) for i, n in sizes], "id bigint, text string").repartition(3)
    ranges = substrings.block_ranges(rows, how)
    assert (np.diff(ranges.limits) > 0).all() and len(ranges.limits) >= 10 and (np.diff(ranges.first) > 0).all()
    held = Counter()
    for i, n in sizes[:-1]:
        held[int(np.searchsorted(ranges.limits, i))] += n
    assert max(held.values()) <= 1000 + 5000
    many = rows.sparkSession.newSession()
    many.conf.set("spark.sql.shuffle.partitions", 200)  # each with less text than a block
    many.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = substrings.block_ranges(many.createDataFrame(rows.collect(), rows.schema), how)
    assert (spread.limits == ranges.limits).all()
    empty = substrings.block_ranges(no_docs.select(F.col("doc_id").alias("id"), "text"), how)
    assert len(empty.limits) == 0 and empty.blocks == 2
    assert how.partitions(50) == 3 and how.table_bits(0) == 15 and how.table_bits(10**15) == 20


def test_leaves_are_in_suffix_order():
    """Suffixes below one internal node lie together, and labels tell what neighbours share."""
    words = Words([" ".join(["a b c d e f g h", f"x{i} y z q r s t {i}"]) for i in range(40)] + [prose(3, 400, 40)])
    plan = substrings.Plan(np.zeros((4, 1 << 15), np.int64), substrings.Repeats())
    at, _, label = plan.leaves(words)
    order = np.argsort(label, kind="stable")
    text = [[words.hash[p + k] for k in range(13)] for p in at[order]]
    shared = [next((k for k in range(13) if a[k] != b[k]), 13) for a, b in zip(text, text[1:])]
    told = substrings.depth(label[order][:-1], label[order][1:], 13)
    assert all(t <= s or t < 13 and s < t for t, s in zip(told.tolist(), shared)) and ((told == 13) == (np.array(shared) == 13)).all()
    places = [i for i, t in enumerate(text) if t[:8] == text[shared.index(max(s for s in shared if s < 13))][:8]]
    assert places == list(range(places[0], places[0] + len(places)))


def test_a_full_block_fits_a_worker():
    """Peak memory of both passes over a block of the largest size, besides the texts."""
    code = """
import resource, numpy as np, pyarrow as pa
from tessella.llm import substrings as s
how, rng = s.Repeats(), np.random.default_rng(1)
vocabulary = np.array([f"w{k:x}" for k in range(4000)])
texts = [" ".join(vocabulary[rng.integers(0, 4000, 300)]) for _ in range(int(1.5 * how.block_bytes / 1250))]
table = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
del texts
plan = s.Plan(np.zeros((4, 1 << 15), np.int64), how)
plan.groups = 200
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
block = s.Block(table, plan)
n = block.sent(0, 0).num_rows
block.removed(pa.table({"g": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())}), 13)
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == 200 and float(out[1]) < 150


def test_mixing(docs, no_docs):
    found = mixing.mix(docs, group_rows=8)
    rows = found.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5), group_rows=8).collect()), key=str)
    size = Counter()
    for r in rows:
        size[r.source] += r.size
    target = plain_targets(size)
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = Counter()
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in size)
    rowwise = mixing.mixed(docs, group_rows=8)
    assert rowwise.columns == docs.columns and rowwise.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_copies_of_many_alike_rows(spark, monkeypatch):
    """Rows of one id, source and size, equal ones and others, in several parts: the mix takes what it says, rows alike to within one."""
    monkeypatch.setattr(mixing, "_PART_ROWS", 7)
    rows = [(None, f"w{i % 20} x y", "a", i % 20) for i in range(60)] + [(None, "same text here", "b", 1)] * 45 + [(i, prose(i, 9), "c", i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, hash int").repartition(4)
    plan = mixing.mix(df, group_rows=8).collect()
    want, units = Counter(), {}
    for r in plan:
        want[(r.doc_id, r.source)] += r.copies
        units.setdefault((r.doc_id, r.source), []).append(r.copies)
    found = mixing.mixed(df, group_rows=8)
    got = Counter(tuple(r) for r in found.collect())
    have = Counter()
    for (i, _, s, _), n in got.items():
        have[(i, s)] += n
    assert found.columns == df.columns and have == +want
    for row, n in Counter(rows).items():
        low, high = min(units[(row[0], row[2])]), max(units[(row[0], row[2])])
        assert high - low <= 1 and n * low <= got[row] <= n * high
    assert got == Counter(tuple(r) for r in mixing.mixed(df.repartition(2), group_rows=8).collect())


@pytest.mark.parametrize("sizes", [{}, {None: 0}, {"a": 10}, {"a": 1, "b": 100, "c": 3, "é": 50, None: 7}, {f"s{k:02d}": 3**(k % 7) for k in range(23)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    found = mixing.source_targets(df).collect()
    assert {r.source: r.target for r in found} == pytest.approx(plain_targets(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0))
    assert [r.source for r in sorted(found, key=lambda r: r.number)] == sorted(sizes, key=lambda s: (s is None, s or ""))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500), st.floats(0, 1, exclude_max=True)), min_size=1, max_size=40))
def test_pivot(units):
    p, size, draws = (np.array(x, float) for x in zip(*units))
    before = (p * size).sum()
    left = mixing.pivot(p, size, draws)
    fractional = [k for k in range(len(p)) if 1e-9 < p[k] < 1 - 1e-9]
    assert fractional in ([], [left]) and (p * size).sum() == pytest.approx(before)


def test_language(docs, no_docs):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5 + str(i), "en" if i % 2 else "de") for i in range(80)]
    known = docs.sparkSession.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(known, "text", "lang", ~is_held_out(F.col("doc_id")))
    assert model.names == ["de", "en"]
    found = {r.doc_id: r for r in langid.predict(known, model).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows)
    out = langid.predict(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (40, 41, 42)} == {"und"}
    assert langid.train(no_docs, "text", "lang", F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"} and langid.predict(no_docs, model).count() == 0


def test_language_scores_against_plain_sums():
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["de", "en", "fr"], np.log([0.2, 0.5, 0.3]), rng.normal(-8, 1, (1 << 10, 3)).astype(np.float32), (1, 2, 3), 10)
    texts = ["Hello, World 12!", "x", "ÄÖ  straße\n\nund so", "a b  c"]
    names, scores = model.score(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        chars = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        total, mass = np.zeros(3), 0
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                gram = chars[i : i + n]
                if " " in (gram if n == 1 else gram[1:-1]):
                    continue
                h = ord(gram[0]) + n
                for c in gram[1:]:
                    h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
                total += model.logp[((h * 0x9E3779B1) & 0xFFFFFFFF) >> 22]
                mass += 1
        z = total / mass**0.5 + model.prior
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(np.argmax(total + model.prior))
        assert name == model.names[best] and score == pytest.approx(p[best], rel=1e-4)


def test_quality_scores_against_plain_loops():
    space = quality.VectorSpace()
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(space.buckets, space.dims)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    texts = ["a b c a", "", "one", None, prose(5, 60)]
    x = quality.pooled(texts, vectors, space)
    for row, text in zip(x, texts, strict=True):
        v = [vectors[space.classes(Words([w]))[0]].astype(float) for w in WORD.findall(text or "")]
        if not v:
            assert not row.any()
            continue
        mean = sum(v) / len(v)
        spread = np.sqrt(np.maximum(sum(u * u for u in v) / len(v) - mean * mean, 0))
        agree = sum(float(a @ b) for a, b in zip(v, v[1:])) / len(v)
        assert row == pytest.approx(np.array([*mean, *spread, agree, np.linalg.norm(mean), np.log1p(len(v))]), abs=2e-3)
    net = quality.Network(rng.normal(size=(60, 5)), (rng.random(60) < 0.5).astype(float), epochs=3)
    rows = rng.normal(size=(4, 5))
    for row, score in zip(rows, net.score(rows), strict=True):
        r = [(a - m) / s for a, m, s in zip(row, net.center, net.scale, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(r, net.p[0][:, k], strict=True)) + net.p[1][k]) for k in range(net.p[0].shape[1])]
        z = sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0]
        assert score == pytest.approx(1 / (1 + np.exp(-z / net.temperature)))


def test_toxicity_scores_against_plain_loops():
    lexicon = toxicity.Induced().merged()
    rng = np.random.default_rng(2)
    weights = np.where(rng.random(toxicity.COLUMNS + 1) < 0.5, rng.normal(size=toxicity.COLUMNS + 1), 0).astype(np.float32)
    texts = ["You are such an IDIOT!!", "a calm text of rivers", "", None, "HELLO THERE moron moron"]
    fired_of = {w: 1 << toxicity.VOTERS.index(name) for name, words in toxicity.LEXICONS.items() for w in words.split()}
    for text, score in zip(texts, toxicity.ToxicityModel(lexicon, None, weights).score(texts), strict=True):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        fired = 0
        for w in words:
            fired |= fired_of.get(w, 0)
        for name, pattern in toxicity.PATTERNS.items():
            fired |= bool(pattern.search(text or "")) << toxicity.VOTERS.index(name)
        columns = {(1 << toxicity.HASH_BITS) + v for v in range(len(toxicity.VOTERS)) if fired >> v & 1}
        for w in words:
            one = Words([w], LETTERS)
            columns |= {int(h[0] >> np.uint64(64 - toxicity.HASH_BITS)) for h in (one.hash, *(one.prefix_hashes(k) for k in toxicity.STEMS)) if h[0]}
        assert score == pytest.approx(1 / (1 + np.exp(-(sum(float(weights[c]) for c in columns) + float(weights[-1])))), rel=1e-5)
    z = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    slope, shift = toxicity.calibration(z, y)
    assert slope == pytest.approx(2, abs=0.6) and shift == pytest.approx(-1, abs=0.4) and toxicity.calibration(z, y * 0) == (1.0, 0.0)


def test_toxicity_label_model():
    bit = lambda *names: sum(1 << toxicity.VOTERS.index(n) for n in names)
    patterns = np.array([0, bit("worth"), bit("worth", "words1"), bit("weak"), bit("shouting")])
    model = toxicity.LabelModel(patterns, np.array([800.0, 20, 60, 70, 50]), np.array([1.0, 6, 20, 2, 1]), np.array([260.0, 0, 0, 20, 15]))
    none, one, both, weak, loud = model.posterior(patterns)
    assert one > 0.9 and both > 0.9 and none < 0.05 and weak < 0.3 and loud < 0.1
    # correlated votes are worth less together than their sum, and each counts in full alone
    logit = lambda q: np.log(q / (1 - q))
    alone = logit(model.posterior(np.array([bit("words1")]))[0])
    assert logit(both) < logit(one) + alone - logit(model.prior)


def test_toxicity_calibration_of_extreme_scores():
    z = np.concatenate([np.full(300, -40.0), np.full(30, 35.0), np.full(5, -38.0), np.full(5, 33.0)])
    y = np.concatenate([np.zeros(300), np.ones(30), np.ones(5), np.zeros(5)])
    slope, shift = toxicity.calibration(z, y)
    assert abs(shift) < 50 and 0.5 < 1 / (1 + np.exp(-(slope * 35 + shift))) < 1


def test_toxicity_refutes_fixed_words(spark):
    rows = [("vile and idiot" if i % 4 == 0 else "vile river", float(i % 4 == 0)) for i in range(80)]
    found = toxicity.induce(spark.createDataFrame(rows, "text string, y double"))
    assert found.refuted.tolist() == Words(["vile"], LETTERS).hash.tolist()
    merged = found.merged()
    assert not np.isin(found.refuted, merged.keys).any() and Words(["idiot"], LETTERS).hash[0] in merged.keys


def learnable(spark):
    clean, junk, bad = "the river runs to the sea and the wind is calm", "BUY!! NOW!! WIN!! $$$ %%% ###", "you idiot and moron what trash"
    rows = [(i, f"{(clean, junk)[i % 4 == 3]} {bad if i % 5 == 0 else ''} number {i}", int(i % 4 != 3), int(i % 5 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int").repartition(3)


def test_quality(spark, docs, no_docs):
    known = learnable(spark)
    sample = quality.labelled_sample(known, "quality", ~is_held_out(F.col("doc_id")), 1000)
    vectors, network = quality.train(known, sample)
    out = {r.doc_id: r.score for r in quality.score(known, vectors, network).collect()}
    held = known.where(is_held_out(F.col("doc_id"))).collect()
    assert len(held) > 50 and sum((out[r.doc_id] >= 0.5) == bool(r.quality) for r in held) >= 0.95 * len(held)
    others = quality.score(docs, vectors, network).collect()
    assert len(others) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in others)
    none = quality.train(no_docs.select("doc_id", "text"), sample.limit(0))
    assert none[1] is None and {r.score for r in quality.score(docs, *none).collect()} == {0.5}


def test_toxicity(spark, docs, no_docs):
    known = learnable(spark)
    ok = ~is_held_out(F.col("doc_id"))
    sample = quality.labelled_sample(known, "toxic", ok, 1000)
    model = toxicity.train(known, sample, ok)
    out = {r.doc_id: r.score for r in toxicity.score(known, model).collect()}
    held = known.where(is_held_out(F.col("doc_id"))).collect()
    assert sum((out[r.doc_id] >= 0.3) == bool(r.toxic) for r in held) >= 0.95 * len(held)
    others = toxicity.score(docs, model).collect()
    assert len(others) == docs.count() and all(0 <= r.score <= 1 for r in others)
    assert toxicity.train(no_docs, sample.limit(0), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    unlabelled = toxicity.train(docs, sample.limit(0), F.lit(True))
    assert toxicity.score(docs, unlabelled).count() == docs.count()
