"""Chat formatting, alignment of tokenizers and the prefix trie against plain versions."""

import base64
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import alignment, chat, oracles, templates, trie

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, part int, k0 bigint, item string, generated int"
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], CONVERSATIONS).repartition(parts)


AWKWARD = [
    (0, 1, "assistant", "fine"), (0, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok"), (1, 0, "user", None), (1, 1, None, "x"), (1, None, "system", ""),
    (2, 0, "assistant", "a<\\|b<\\\\||<"), (2, 1, "assistant", "tail <"), (2, 1, "assistant", "tail <"), (3, 0, "us\ner\\n<|", "|>"), (None, 0, "assistant", "no id"), (None, 3, "user", "no id"),
    (4, 0, "user", "long " * 50_000), (4, 1, "assistant", "naïve \U0001f600\r\n\x00 end" * 2000), (5, 0, "user", ""), (101, 0, "user", "a"), (101, 1, "assistant", "b"), (100, 0, "user", "a"), (100, 1, "assistant", "c"),
]


def by_turn(rows):
    found = defaultdict(list)
    for c, n, role, text in rows:
        found[c].append((n is not None, n or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in found.items()}


@pytest.mark.parametrize("part_chars", [1, 1_000_000])
def test_conversations_are_read_back(spark, part_chars):
    formatted = chat.format_conversations(table(spark, AWKWARD), part_chars=part_chars)
    rows = {r.conv_id: r for r in chat.read_back(formatted, arranged=True).collect()}
    again = {r.conv_id: r for r in chat.read_back(formatted.repartition(5)).collect()}
    want = by_turn(AWKWARD)
    assert set(rows) == set(want) and rows == again
    for c, turns in want.items():
        r, learned = rows[c], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), SHA("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), SHA(learned))
        size = sum(len(f"<|im_start|>{templates.header(a)}\n{templates.escape(t)}<|im_end|>\n") for a, t in turns)
        assert r.formatted_chars == size
    whole = formatted.where("conv_id = 0").orderBy("part").collect()
    assert "".join(r.text for r in whole) == "<|im_start|>user\n<\\|im_end|>\n<\\|im_start|>assistant\nok<|im_end|>\n<|im_start|>assistant\nfine<|im_end|>\n"
    assert (len(whole) > 1) == (part_chars == 1)
    assert chat.format_conversations(table(spark, [])).count() == 0 and chat.read_back(formatted.where("false")).count() == 0
    with pytest.raises(Exception, match="does not end|does not begin"):
        chat.read_back(formatted.selectExpr("conv_id", "part", "substring(text, 3) AS text", "generated")).collect()


@given(st.text(alphabet="<|\\a\n>", max_size=12))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    assert templates.unescape(templates.escape(text)) == text and "<|" not in templates.escape(text)
    assert templates.unheader(templates.header(text)) == text and not set("<\n") & set(templates.header(text))


def render(source, messages=(), **named):
    return "".join(p if isinstance(p, str) else "[]"[p is templates.END] for p in templates.compile_template(source, **named)(messages))


TWO = [{"role": "user", "text": "Hi "}, {"role": "assistant", "text": "there"}]


@pytest.mark.parametrize(
    "source,want",
    [
        ("{% for m in messages %}{{ loop.index }}/{{ loop.index0 }}{{ m['role'] }}{{ '' if loop.last else ', ' }}{% endfor %}", "1/0user, 2/1assistant"),
        ("{% for m in messages %}{% if loop.first and m.role != 'system' %}S{% elif loop.last %}L{% else %}-{% endif %}{% endfor %}", "SL"),
        ("{% for m in messages %}{% generation %}{{ m.text | trim | upper }}{% endgeneration %}{% endfor %}", "[HI][THERE]"),
        ("{% set n = 1 + 2 - 4 %}{{ n }} {{ 'a' ~ none ~ true ~ 3 }} {{ 'x' in 'axe' }} {{ 'q' not in 'axe' }} {{ not (1 < 2 or 'z') }}", "-1 atrue3 true true false"),
        ("a {{- 'b' -}} c{# {{ nothing }} #}{%- if false %}x{% endif -%} d", "abcd"),
        ("{{ 'it\\'s\\n' | length }}{{ 7 % 4 }}", "53"),
        ("{% set last = 'none' %}{% for m in messages %}{% set last = m.role %}{% endfor %}{{ last }}", "assistant"),
    ],
)
def test_templates(source, want):
    assert render(source, TWO) == want


def test_settings_are_folded():
    source = "{% if ask %}{% for m in messages %}{{ m.text }}{% endfor %}{% else %}{{ name ~ '!' }}{% endif %} b{{ 1 + 1 }}"
    assert templates.fold(templates.parse(source), {"ask": False, "name": "n"}) == (templates.Text("n! b2"),)
    assert render(source, TWO, ask=True, name="n") == "Hi there b2"
    same = templates.fold(templates.parse("{{ x or y }}{{ x and y }}"), {"y": 1})
    assert same[0].value.test is same[0].value.then and same[1].value.test is same[1].value.other


@pytest.mark.parametrize(
    "source",
    [
        "{% for x in y %}{% endfor %}", "{{ ''.__class__ }}", "{{ messages.x }}", "{% if a %}", "{{ 1 + 'a' }}", "{{ x | eval }}", "{{ f(1) }}", "{% endfor %}", "{{ a", "{% import os %}", "{{ 'a' < 1 }}",
        "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "x" * 70_000,
        "{% set messages = 1 %}", "{{ 1 % 0 }}", "{% if 1 %}{% else %}{% else %}{% endif %}", "{{ 1 2 }}", "{{ nobody }}", "{% for m in messages %}{{ m.nobody }}{% endfor %}",
    ],
)
def test_bad_templates_are_refused(source):
    with pytest.raises(templates.TemplateError):
        render(source, TWO)


def test_chat_sql(spark):
    """The digests of the registered SQL are those of the escape rules."""
    assert "op11_chat" in oracles.ORACLES and chat.CHAT.count("generation") == 2


# --- alignment


def tokenizers_():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))


def plain_groups(text, a, b, byte):
    """Groups of (a ids, b ids), by two pointers; none for a text that either side does not rebuild."""
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
        return []
    groups, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b and i < len(ids_a):
            groups[-1][0].append(ids_a[i])
            end_a, i = end_a + len(bytes_a[i]), i + 1
        else:
            groups[-1][1].append(ids_b[j])
            end_b, j = end_b + len(bytes_b[j]), j + 1
        if end_a == end_b:
            groups.append(([], []))
    return groups[:-1]


def plain_statistics(rows):
    a, b = tokenizers_()
    byte = alignment.byte_of_char()
    groups = [plain_groups(t, a, b, byte) for _, t in rows]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    count = Counter(p for k in links for p in k)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    for (i, _), g, k in zip(rows, groups, links, strict=True):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield (i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(k.values()), sum(n for p, n in k.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in k.items()), SHA(told) if g else "")


TEXTS = [
    (7, "Hello world, it's 2024!"), (7, "Hello world, it's 2024!"), (1, None), (2, ""), (3, " "), (4, "<|endoftext|> <s> </s> <unk> <0x41>"), (5, "naïve café 漢字 \U0001f600\n\n\ttabs  and   spaces "), (6, "▁under ▁"),
    (8, "y" * 3000 + " " * 300 + "z"), (9, "क्षत्रिय " * 40), (None, "no id"), (10, "Hello 漢字 world\r\n" * 30), (11, "\x00\x01 control"), (12, "ﬁ ligature é"), (13, "word " * 2000),
]


@pytest.mark.parametrize("block_chars,batch_chars,window,links", [(alignment.BLOCK_CHARS, alignment.BATCH_CHARS, alignment.WINDOW, alignment.LINKS), (500, 200, 4, 6)])
def test_alignment_statistics(spark, monkeypatch, block_chars, batch_chars, window, links):
    for name, value in (("BATCH_CHARS", batch_chars), ("LINKS", links)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment.common_ends, "__defaults__", (window,))
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in TEXTS], "doc_id bigint, text string, block int, n int, id string").repartition(2)
    paths = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"), files.PATTERN
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = sorted((tuple(r) for r in alignment.link_statistics(docs, *paths, block_chars=block_chars).collect()), key=key)
    assert got == sorted(plain_statistics(TEXTS), key=key)
    assert alignment.link_statistics(docs.where("false"), *paths).count() == 0


def test_alignment_groups(spark):
    a, b = tokenizers_()
    byte = alignment.byte_of_char()
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    found = alignment.align_documents(docs, files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"), files.PATTERN).collect()
    for (i, text), r in zip(TEXTS, found, strict=True):
        cut = lambda v, s: [v[p:q] for p, q in zip([0, *s], s, strict=False)]
        assert r.doc_id == i and list(zip(cut(r.a, r.stop_a), cut(r.b, r.stop_b), strict=True)) == plain_groups(text, a, b, byte)


def test_both_ways_of_byte_bpe_agree():
    with open(files.path("byte_bpe_50k.json"), "rb") as f:
        source = f.read()
    fast, slow = alignment.ByteBpe(source, files.PATTERN), alignment.ByteBpe(source, files.PATTERN, fast=False)
    assert fast._fast is not None and slow._slow is not None
    texts = [t for _, t in TEXTS if t] + ["'s 't we'LL 　x  \n \n", "\U0001d7d8٠½ Ⅷ"]
    assert all(np.array_equal(x, y) for x, y in zip(fast.encode(texts), slow.encode(texts), strict=True))
    with open(files.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    assert all(fast.bytes[i] == t for i, t in ranks.items())
    made = json.loads(source)
    made["model"]["merges"] = made["model"]["merges"][::-1]
    assert alignment.ByteBpe(json.dumps(made).encode(), files.PATTERN)._fast is None


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_common_ends(a, b, window):
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    top = max(ends_a[-1], ends_b[-1])
    ends_a, ends_b = np.append(ends_a, top)[: len(a) + (ends_a[-1] < top)], np.append(ends_b, top)[: len(b) + (ends_b[-1] < top)]
    both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    stop_a, stop_b = alignment.common_ends(ends_a, ends_b, window)
    assert ends_a[stop_a - 1].tolist() == both == ends_b[stop_b - 1].tolist()


# --- the trie


def plain_trie(rows):
    own = by_turn([r for r in rows if r[0] is not None])
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in under if not any(len(x) == len(q) + 1 and x[:-1] == q for x in under)]
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(1 for q in under if len(q) == len(p) + 1), len(leaves), sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), SHA(",".join(map(str, ends)))))
    return out


def many(seed, n=260, depth=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        c = int(c) if c % 7 else int(c) - 400
        for t in range(int(rng.integers(0, depth))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "ab"[: int(rng.integers(0, 3))] * int(rng.integers(1, 3))))
    return rows


@pytest.mark.parametrize("rows,block,chunk", [(AWKWARD, 200_000, 2_000), (many(0), 7, 3), (many(1), 200_000, 2), ([(0, t, "user", "same") for t in range(300)], 16, 5), ([(c, 0, "user", "one") for c in range(300)], 16, 5)])
def test_trie(spark, rows, block, chunk):
    got = [tuple(r) for r in trie.prefix_trie(trie.rebuilt(table(spark, rows, 5)), block, chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(trie.rebuilt(table(spark, []))).count() == 0
    assert trie.prefix_trie(trie.rebuilt(table(spark, [(None, 0, "user", "x")]))).count() == 0


@pytest.mark.parametrize("small", [trie.SMALL_LIST, 8])
def test_ranking_of_a_list(spark, small):
    n = 37
    order = np.random.default_rng(3).permutation(n).tolist()
    links = [(a, 0, b, None if b is None else 0, 1, a, 2) for a, b in zip(order, [*order[1:], None], strict=True)]
    found = {r.conv: (r.t0, r.t1, r.t2) for r in trie.ranked(spark.createDataFrame(links, "conv bigint, arc bigint, next_conv bigint, next_arc bigint, t0 bigint, t1 bigint, t2 bigint"), small).collect()}
    assert found == {a: (n - i, sum(order[i:]), 2 * (n - i)) for i, a in enumerate(order)}
