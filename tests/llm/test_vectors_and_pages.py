"""Vectors, pages, components and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
import public_tokenizers
from plain import WORD, components, plain_targets, repeats, shingles, without_repeats
from tessella.llm import bpe, embeddings, pages, repetition
from tessella.llm.components import connected_components


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(6000, 6100)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(pairs + [(None, 3)], "a bigint, b bigint")).collect()
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


SCHEMA = "vec_id bigint, embedding array<float>, label int, rep int, links string"


def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [(i, v, i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, base[i] + rng.standard_normal(16) * 0.25, i % 3) for i in range(30)]
    rows += [(200 + i, base[0] * (i + 1), 0) for i in range(4)] + [(300 + i, base[1] + rng.standard_normal(16) * 0.15, 1) for i in range(90)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [float("inf")] * 16, 1), (404, [], 1), (405, [None] * 16, 1)]
    rows += [(406, rows[0][1], None), (407, [1.0, 0.0], 0), (408, [1.0, 0.0], 0), (409, rows[0][1], 1), (None, rows[0][1], 0)]
    return rows


def test_embeddings(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors()], SCHEMA)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    good = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and v and label is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, parent = {}, {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x, la in good:
        for b, y, lb in good:
            if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    for how in (embeddings.Projections(miss_cell=1e-9), embeddings.Projections(miss_cell=1e-9, block=16)):
        found = embeddings.near_duplicates(df, how=how).collect()
        assert len(found) == len(rows) and len(links) > 100
        for r in found:
            if r.vec_id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, False)
            else:
                assert (r.vec_id, r.n_links, r.component_id) == (r.vec_id, links.get(r.vec_id, 0), find(r.vec_id)) and r.kept == (find(r.vec_id) == r.vec_id)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_vectors(spark):
    """Pairs just above the threshold are found as often as calibrated, and most unrelated pairs are never counted."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((600, 64))
    rows, n = [], 0
    for k, v in enumerate(base):
        v = v / np.linalg.norm(v)
        rows.append((2 * k, v, k % 2))
        if k < 300:
            u = rng.standard_normal(64)
            u -= (u @ v) * v
            c = rng.uniform(0.931, 0.97)
            rows.append((2 * k + 1, c * v + np.sqrt(1 - c * c) * u / np.linalg.norm(u), k % 2))
            n += 1
    df = spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id bigint, embedding array<double>, label int").repartition(3)
    found = embeddings.near_duplicates(df).collect()
    assert sum(r.n_links for r in found) / 2 >= 0.9 * n and all(r.component_id in (r.vec_id, r.vec_id - 1) for r in found)
    assert embeddings.share_counted(df) < 0.05
    functions, tables = embeddings.Projections().shape(5000)
    near = embeddings.same_place(2.0, embeddings.Projections().distance) ** functions
    assert (1 - near) ** tables <= 0.05
    z = np.abs(np.random.default_rng(1).standard_normal(200_000) * 0.374)
    assert abs(np.maximum(0, 1 - z / 2).mean() - embeddings.same_place(2.0, 0.374)) < 0.005


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to give you the best of all experiences, as you know.</p></div>
<article><h1>A &amp; B</h1><p>First <b>bold</b>
 text&nbsp;here.<p>Second.<br>line<ul><li>point one</li><li>point two</li></ul><div class="ad"><p>Buy it now</p></div>
<section id="comments"><p>Nice post by a reader who liked it very much indeed.</p></section></article>
<aside><p>Related things</p></aside><form><p>Your mail</p><input></form><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", ""), (3, None, None), (None, "u", "just text & <i>more</i>" + " of it" * 30), (1, "u", PAGE), (5, "u", "<<<><p a='>'>" + "x " * 40), (6, "u", "<script>never closed")]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    found = pages.extract(df).collect()
    assert [(r.page_id, r.url) for r in found] == [(i, u) for i, u, _ in rows]
    assert found[0].text == found[4].text == "A & B\nFirst bold text here.\nSecond. line\npoint one\npoint two"
    assert found[1].text == found[2].text == found[6].text == "" and found[3].text == "just text & more" + " of it" * 30
    assert all(r.n_chars == len(r.text) for r in found)
    assert pages.extract(df.limit(0)).count() == 0


LONG = "The text of the page goes on with a good many words that nobody should lose on the way to its reader. " * 3


@pytest.mark.parametrize(
    "before",
    [
        "<svg class='i'/>", "<math/>", "<p><svg viewBox='0 0 1 1' /></p>", "<svg-icon>i</svg-icon>", "<button-group></button-group>", "<select-menu></select-menu>",
        "<object-view></object-view>", "<title-bar></title-bar>", "<button>Menu", "<iframe src='/x'>", "<object data='x'>", "<button>Menu<p></p><button>More</button>",
        "<select><option>a<option>b", "<svg><svg></svg></svg>", "<template><p>hidden row</p></template>", "<noscript><p>Enable it</p></noscript>", "<canvas>none</canvas>",
    ],
)
def test_embedded_elements_leave_the_article(before):
    page = f"<html><body><div>{before}</div><article>{before}<p>{LONG}</p></article></body></html>"
    found = pages.main_texts([page], pages.default_tree())[0]
    assert LONG.strip() in found and not any(w in found for w in ("Menu", "More", "hidden", "Enable", "none"))


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-comments", "post-share-enabled", "sidebar-left layout"])
def test_wrappers_leave_the_article(name):
    page = f"<body><div class='{name}'><article><p>{LONG}</p></article><div class='comments'><article class='comment'><p>Not this one here</p></article></div></div></body>"
    assert pages.main_texts([page], pages.default_tree()) == [LONG.strip()]
    hidden = f"<body><aside><article><p>{LONG}</p></article></aside><div hidden><main><p>{LONG}</p></main></div></body>"
    assert pages.main_texts([hidden], pages.default_tree()) == [""]


def test_teaser_article_does_not_hide_the_text():
    page = f"<body><article><p>A short teaser of some other page</p></article><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert LONG.strip() in pages.main_texts([page], pages.default_tree())[0]


def test_tree():
    rng = np.random.default_rng(0)
    x = rng.random((200, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert (pages.Tree(x, y).predict(x) == y).all()
    found, labels = pages.labelled_pages()
    table = np.concatenate([pages.block_features(p) for p in found])
    assert (pages.default_tree().predict(table) == labels).all() and len({tuple(r) for r in table}) > 0.9 * len(table)


def test_neighbours_and_sizes_change_verdicts():
    """Pages without a main element: what a block's neighbours and hinted element hold decides."""
    tree = pages.default_tree()
    soup = "<body><div><li><a>Home</a></li><li>News</li><li><a>Sport</a></li></div><h2>A title of some words</h2>" + f"<p>{LONG}</p><p>So.</p><p>{LONG}</p>" * 4 + "<div class='cookie'><p>We use cookies on this site</p></div>"
    wrapped = f"<body><div class='hentry category-legal'><h1>The law</h1>{f'<p>{LONG}</p><p>So.</p>' * 4}</div><div class='legal'><p>All rights are kept by us</p></div>"
    changed = 0
    for page in (soup, wrapped):
        rows = pages.block_features(pages.text_blocks(page))
        own = tree.predict(rows)
        for columns in ((2, 3, 4, 5), (10, 11), (0, 1)):
            other = rows.copy()
            other[:, columns] = 0
            changed += int((tree.predict(other) != own).sum())
    assert changed > 3
    kept = pages.main_texts([soup, wrapped], tree)
    assert kept[0] == "\n".join(["A title of some words"] + [LONG.strip(), "So.", LONG.strip()] * 4)
    assert kept[1] == "\n".join(["The law"] + [LONG.strip(), "So."] * 4)


def test_comments_go_wherever_they_stand():
    inside = f"<main><article><p>{LONG}</p></article><article class='comment'><p>{LONG} says a reader</p></article><ol class='comment-list'><li>{LONG}</li></ol></main>"
    assert pages.main_texts([inside], pages.default_tree()) == [LONG.strip()]


@pytest.mark.parametrize("part", ["<p ", '<p "', "<a '\">", "<", "<!--", "<svg>", "<div>", "<script>", "<p a='", "<![CDATA[", "</p", "<iframe x=\""])
def test_broken_pages_take_linear_time(part):
    import time

    pages.default_tree()
    began = time.process_time()
    pages.main_texts([part * (1_000_000 // len(part)), part * (500_000 // len(part)) + '">'], pages.default_tree())
    assert time.process_time() - began < 15  # seconds even on a slow machine; a quadratic reader takes hours


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<li>", "<a href='x>y'>", "</a>", "word ", "<b>", '"', "'", "<", ">", "<!-- x -->", "&amp;", "<nav>", "</nav>", "<br>"]), max_size=30))
def test_tags_end_where_a_plain_reader_finds_it(parts):
    """The scanner against a plain one that walks every tag character by character."""
    page = "".join(parts)
    scanner = pages._Scanner(page)
    for m in pages._NAME.finditer(page):
        at, quote = m.end(), None
        while at < len(page) and (quote or page[at] != ">"):
            if page[at] == quote:
                quote = None
            elif not quote and page[at] in "\"'" and page[at] in page[at + 1 :]:
                quote = page[at]
            at += 1
        want = at + 1 if at < len(page) else page.find(">", m.end()) + 1 or -1
        assert scanner.end(m.end()) == want


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, docs, no_docs, empty, tmp_path):
    """Every stage against a plain version on what the stage before it kept."""
    now = no_docs if empty else docs
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        out = stage(spark, now, "unused")
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        tables.append((before, now.collect()))
    if empty:
        assert all(not after for _, after in tables)
        return
    (before, after) = tables[0]
    measured = dict(zip([r.text for r in before], repetition.measure([r.text for r in before])))
    assert Counter(after) == Counter(r for r in before if measured[r.text][-1])
    for r in before:  # the base rule, and what a good text cannot have
        words = WORD.findall(r.text or "")
        if len(words) < 20 or 100 * sum(repeats(words, 8)) > 30 * len(words):
            assert not measured[r.text][-1]
    assert {50, 3, 10, 11, None} <= {r.doc_id for r in after} and not {40, 41, 47, 48} & {r.doc_id for r in after}

    (before, after) = tables[1]
    sets = [(r.doc_id, shingles(r.text, 5)) for r in before if r.doc_id is not None]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = components({i for i, _ in sets}, links)
    assert {(r.doc_id, r.text) for r in after} == {(r.doc_id, r.text) for r in before if r.doc_id is None or root[r.doc_id] == r.doc_id}
    assert len(after) == len({(r.doc_id, r.text) for r in after if r.doc_id is not None}) + sum(r.doc_id is None for r in before)

    (before, after) = tables[2]
    plain = list(without_repeats([(r.doc_id, r.text) for r in before]))
    assert Counter((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in after) == Counter(
        (i, sha) for i, n, lost, sha in plain if not n or lost < n
    )
    assert sum(lost for _, _, lost, _ in plain) > 0

    (before, after) = tables[3]
    number, taken, size, most = Counter(before), Counter(after), Counter(), Counter()
    assert set(taken) <= set(number) and all(n <= 3 * number[r] for r, n in taken.items())
    words = {r: len(WORD.findall(r.text or "")) for r in before}
    for r in before:
        size[r.source] += words[r]
        most[r.source] = max(most[r.source], words[r])
    target = plain_targets(size)
    for source in size:
        assert abs(sum(n * words[r] for r, n in taken.items() if r.source == source) - target[source]) <= most[source] + 1e-6

    (before, after) = tables[4]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = bpe.Codec(bpe.load_ranks(path), pattern).encoding
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in after) == Counter(
        (r.doc_id, (ids := tuple(encoding.encode_ordinary(r.text or ""))), len(ids), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before
    )
