"""Articles in elements whose names or tags speak against them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, pages

LONG = "The text of the page goes on with a good many words that nobody should lose on the way to its reader. " * 3
BODY = "\n".join(["A title", LONG.strip(), LONG.strip()])
ARTICLE = f"<h1>A title</h1><p>{LONG}</p><p>{LONG}</p>"
COMMENTS = "<div class='comments'><p>I say this here and that as well</p><p>" + LONG * 3 + "</p></div>"


def text(page):
    return pages.main_texts([page], pages.default_tree())[0]


@pytest.mark.parametrize(
    "page",
    [
        f'<body><nav><a>Home</a></nav><div class="post comments-open">{ARTICLE}{COMMENTS}</div><footer>All rights kept by us</footer></body>',
        f'<article class="hentry comment-status-closed">{ARTICLE}</article>{COMMENTS}',
        f'<div class="chemistry reactions">{ARTICLE}</div>', f'<div class="content replies">{ARTICLE}</div>', f'<div class="page respond">{ARTICLE}</div>',
        f'<main><section id="reactions">{ARTICLE}</section></main>',
        f'<form id="aspnetForm"><div class="menu"><a>x</a></div>{ARTICLE}{COMMENTS}<p><a>next</a></p></form>',
        f'<form><div class="comments-open"><header><p>Our site</p></header>{ARTICLE}<ol class="commentlist"><li>{LONG}</li></ol></div></form>',
        f"<html><head><title>a</title>{ARTICLE}", f"<html><head><meta charset='utf-8'><link rel='x'><script>1</script>{ARTICLE}", f"<body><header>{ARTICLE}</header></body>",
        f"<body style='visibility:hidden'>{ARTICLE}</body>",
    ],
)
def test_wrapped_articles_are_kept(page):
    assert text(page) == BODY


@pytest.mark.parametrize("depth", [100, 150, 250, 5000])
def test_unclosed_elements_end_with_those_around_them(depth):
    assert text("<nav>" + "<div>" * depth + f"menu</nav><main><p>{LONG}</p></main>") == LONG.strip()


def test_a_page_of_several_wrapped_articles():
    page = "".join(f'<article class="post comments-open"><h2>Title {i}</h2><p>{LONG}</p></article>' for i in range(4))
    assert text(page) == "\n".join(x for i in range(4) for x in (f"Title {i}", LONG.strip()))


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><div id='comments'><p>{LONG}</p><p>{LONG}</p></div></body>", ""),
        (f"<body><article><h1>Short</h1><p>Only these few words of an article are here</p></article><div class='comments'><p>{LONG * 5}</p></div></body>", "Short\nOnly these few words of an article are here"),
        (f"<body><div style='display:none'><form>{ARTICLE}</form></div></body>", ""), (f"<body><nav>{LONG}</nav><footer>{LONG}</footer></body>", ""),
        (f"<head><title>t</title></head><body>{ARTICLE}<form><p>Write to us and we answer soon</p></form></body>", BODY),
    ],
)
def test_what_is_not_the_article_goes(page, want):
    assert text(page) == want


def test_wrappers_are_told_by_what_they_hold():
    x, y = pages.labelled_wrappers()
    tree = pages.wrapper_tree()
    assert (tree.predict(x) == y).all()
    used = {n[0] for n in tree.nodes if n[0] >= 0}
    assert len(used) >= 5  # shares, words here and elsewhere, headings, and last the kind
    for column in used:
        other = x.copy()
        other[:, column] = 0
        assert (tree.predict(other) != y).any()


@pytest.mark.parametrize("part", ["<form>", "<div class='comments-open'>", "<div></nav>", "<form><p>word</p>"])
def test_deep_wrappers_take_linear_time(part):
    pages.default_tree()
    began = time.process_time()
    text(part * (600_000 // len(part)))
    assert time.process_time() - began < 30


def test_many_languages(spark):
    rows = [(i, f"text {i} of words", f"l{i % 300}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(2)
    model = langid.train(docs, "text", "lang", F.lit(True))
    assert len(model.names) == 300 and np.allclose(np.exp(model.prior).sum(), 1, atol=1e-6)
    few = docs.where("doc_id < 40")
    want = langid.train(few, "text", "lang", F.lit(True))
    import tessella.llm.langid as module

    kept, module._LANGUAGES_A_TASK = module._LANGUAGES_A_TASK, 3
    try:
        got = langid.train(few, "text", "lang", F.lit(True))
    finally:
        module._LANGUAGES_A_TASK = kept
    assert got.names == want.names and np.allclose(got.logp, want.logp) and np.allclose(got.prior, want.prior)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, "text", "lang", F.lit(True), max_languages=100)
