"""Main text of web pages: flat text blocks and a decision tree.

A page becomes a flat list of text blocks (runs of text between block-level tags).  Each block has its
word count and link density, those of the blocks before and after it, its kind of tag and
where it stands: in the page's main element, in an element that does not hold the article (navigation, footer, form, reader
comments), or in one whose name hints at something else, with the words that this element holds in all.
A decision tree, grown from the small labelled table below, keeps or drops each block.

No name or tag alone bars an element: the classes of blog software, page-wide forms and the like also surround articles.  A second
small tree tells such wrappers by what they hold: their share of the page's running text, how much there is elsewhere, headings and links.

The page is read once from left to right; broken tags, quotes and comments do not make it read anything again.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
# Elements whose content is no markup, and what ends it.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title")}
# Elements without article text; one that is never closed ends at the next block-level tag.
_MUTED = {
    tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I)
    for tag in ("noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "button")
}
_HINTS = re.compile(r"""(?:^|\s)(class|id|role|style|aria-label|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)

# Elements that start a block of their own, and those that hold others.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul video audio".split()
)
_HOLDER = _BLOCK - frozenset("p hr h1 h2 h3 h4 h5 h6 dt dd li td th tr".split())
_ASIDE = frozenset("nav aside footer form menu dialog search fieldset head".split())
# Words of class, id and role that name reader comments, and others that hint at what is not the article.
_COMMENTS = "comments? commentlist comment-?list respond disqus replies reactions".split()
_OTHERS = (
    "ads? adverts? advertisements? adbox adsense sponsor(?:ed)? promo(?:tion)?s? banners? sidebars? side-?bar nav(?:bar|igation)? menus? breadcrumbs? "
    "footers? site-?header page-?header masthead topbar cookies? consent gdpr notices? alert popups? modal overlay share sharing social related "
    "recommend(?:ed|ations)? newsletter subscribe subscription signup login search widgets? pagination pager toolbar skip copyright legal disclaimer "
    "contentinfo complementary navigation dialog tags metadata hidden sr-only visually-hidden paywall outbrain taboola"
).split()


def _named(words: list[str]) -> re.Pattern:
    """The words, as a part of a name between blanks, hyphens and underscores; not in ``has-x``, ``no-x``, ``with-x`` or ``x-enabled``."""
    return re.compile(rf"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bno[_-])(?<!\bwith[_-])(?:{'|'.join(words)})(?:$|[\s_-])(?!(?:enabled|disabled)\b)", re.I)


_COMMENT, _OTHER = _named(_COMMENTS), _named(_OTHERS)
#: Where a block stands: nowhere special, in an element with a hint in its name, in one that does not hold the article.
FREE, HINTED, BARRED = 0, 1, 2
#: Why an element is barred: by a part of a name or as a form or header, by the whole name of a comment list, by its kind, as hidden.
NAMED, LISTED, KIND, HIDDEN = 0, 1, 2, 3
# Names that a list of reader comments has, and nothing else.
_LISTS = frozenset("comments commentlist comment-list disqus disqus_thread respond".split())


def _standing(tag: str, rest: str, in_main: bool) -> tuple[int, int]:
    """Standing and, if BARRED, why: by the kind of element, as hidden or as reader comments; HINTED by a word of its class, id or role."""
    found, why = (BARRED, NAMED if tag in ("form", "fieldset", "header") else KIND) if tag in _ASIDE or tag == "header" and not in_main else (FREE, NAMED)
    if not rest:
        return found, why
    for name, value in _HINTS.findall(rest):
        value, name = value.strip("\"'"), name.lower()
        if name == "style":
            if tag not in ("body", "html") and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return BARRED, HIDDEN
        elif name == "aria-hidden":
            if tag not in ("body", "html") and value.lower() == "true":
                return BARRED, HIDDEN
        elif tag not in ("body", "html") and found != BARRED:
            if _COMMENT.search(value) and not re.fullmatch(r"h[1-6]", tag):
                found, why = BARRED, LISTED if value.lower() in _LISTS else NAMED
            elif tag not in ("article", "main") and _OTHER.search(value) and not (tag == "header" and in_main) and not re.fullmatch(r"h[1-6]", tag):
                found = HINTED
    if tag not in ("body", "html") and _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", rest)):
        return BARRED, HIDDEN
    return found, why


class _Scanner:
    """Finds where tags end, in time linear in the page for all tags together."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()  # stops from which no end outside quotes follows
        self.known = (0, -1, False)  # no stop from the first to before the second position

    def _stop(self, at: int) -> int:
        a, b, none = self.known
        if a <= at and (none or at <= b):
            return -1 if none else b
        m = _STOP.search(self.page, at)
        self.known = (at, m.start() if m else -1, m is None)
        return m.start() if m else -1

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: after the next ``>`` outside quotes, else after the
        next one at all; -1 if there is none."""
        seen, q = [], at
        while (s := self._stop(q)) >= 0 and s not in self.dead:
            c = self.page[s]
            if c == ">":
                return s + 1
            seen.append(s)
            # a quote that is never closed is a character like others
            q = self.page.index(c, s + 1) + 1 if s < self.last[c] else s + 1
        self.dead.update(seen)
        return self.page.index(">", at) + 1 if at <= self.last[">"] else -1


#: A block: text, words, words in links, standing, in the main element, tag kind, number of the hinted element (or -1).
Block = tuple[str, int, int, int, bool, int, int]
#: Kinds of tags.
PLAIN, HEADING, ITEM = 0, 1, 2


# Elements that can stand in the head of a page; any other one, or text, ends it.
_HEAD = frozenset("base link meta title style script noscript template".split())


class _Standings:
    """Which elements bar or hint, by number: blocks belong to the innermost of each."""

    def __init__(self) -> None:
        self.parent: list[int] = []  # the barring element around each barring element, or -1
        self.why: list[int] = []
        self.hints = 0

    def enter(self, own: tuple[int, int], barred: int, hinted: int) -> tuple[int, int]:
        """Numbers inside an element that stands as ``own`` inside these."""
        if own[0] == BARRED:
            self.parent.append(barred)
            self.why.append(own[1])
            return len(self.why) - 1, hinted
        if own[0] == HINTED and hinted < 0:
            self.hints += 1
            return barred, self.hints
        return barred, hinted


def text_blocks(page: str, wrappers: Tree | None = None) -> list[Block]:
    """Flat blocks of a page in its order."""
    raw: list[tuple[str, int, int, int, int, bool, int, bool]] = []
    stack: list[tuple[str, int, int, bool]] = []  # open holders: tag, numbers of the barring and hinting elements, main
    opened: Counter[str] = Counter()  # their tags
    words: list[str] = []
    linked = link = 0
    kind, top = PLAIN, False
    alone: tuple[str, int, int] | None = None  # an element with a standing of its own that holds no others, such as a list item
    silent: str | None = None  # an element of _MUTED without an end tag of its own
    found = _Standings()
    scanner = _Scanner(page)

    def close() -> None:
        nonlocal words, linked
        text = " ".join(html.unescape("".join(words)).split()) if words else ""
        if text:
            barred, hinted, main = stack[-1][1:] if stack else (-1, -1, False)
            if alone:
                barred, hinted = alone[1:]
            n = text.count(" ") + 1
            share = linked / max(1, sum(len(w) for w in words))
            raw.append((text, n, round(share * n), barred, hinted, main, kind, top))
        words, linked = [], 0

    def leave(tag: str) -> None:
        """Closes the innermost open element of that name, and those inside it."""
        while opened[tag]:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == tag:
                break

    def add(text: str) -> None:
        nonlocal linked
        if text and not silent:
            if stack and stack[-1][0] == "head" and not text.isspace():
                leave("head")
            words.append(text)
            if link:
                linked += len(text)

    at = 0
    while (lt := page.find("<", at)) >= 0:
        add(page[at:lt])
        if page.startswith(("<!--", "<![CDATA["), lt):
            mark = "-->" if page[lt + 2] == "-" else "]]>"
            end = page.find(mark, lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = _NAME.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/") and lt < scanner.last[">"] and page[lt + 1 : lt + 2]:
                at = page.index(">", lt) + 1
            else:
                add("<")
                at = lt + 1
            continue
        ending, tag = m[1], m[2].lower()
        at = scanner.end(m.end())
        if at < 0:
            add("<")
            at = lt + 1
            continue
        rest = page[m.end() : at - 1]
        if not ending and stack and stack[-1][0] == "head" and tag not in _HEAD and tag != "head":
            leave("head")
        if tag in _RAW and not ending:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag in ("title", "textarea"):
                add(" ")
            continue
        if tag in _MUTED:
            if tag in ("select", "button", "iframe", "object"):
                add(" ")
            if ending:
                silent = None if silent == tag else silent
            elif not (tag in ("svg", "math") and rest.endswith("/")):
                edge = _MUTED[tag].search(page, at)
                end = scanner.end(edge.end()) if edge and edge[1] else -1
                if end >= 0:
                    at = end
                else:
                    silent = silent or tag
            continue
        if tag in _BLOCK and not (silent == "select" and tag in ("option", "optgroup", "hr")):
            silent = None
        if tag == "br" or tag == "img":
            add(" ")
        elif tag == "a":
            link = 0 if ending else 1
        elif tag in _BLOCK:
            close()
            link = 0
            if ending:
                kind, top = PLAIN, False
                if alone and alone[0] == tag or tag in _HOLDER:
                    alone = None
                if tag in _HOLDER:
                    leave(tag)
            else:
                barred, hinted, main = stack[-1][1:] if stack else (-1, -1, False)
                own = _standing(tag, rest, main)
                kind = HEADING if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else ITEM if tag in ("li", "td", "th", "dt", "dd") else PLAIN
                top = tag == "h1"
                if tag in _HOLDER:
                    alone = None
                    if tag == "body":
                        stack.clear()
                        opened.clear()
                        barred, hinted, main = -1, -1, False
                    if tag in ("article", "main") and not main and own[0] == FREE:
                        hinted = -1
                    stack.append((tag, *found.enter(own, barred, hinted), main or tag in ("article", "main")))
                    opened[tag] += 1
                else:
                    alone = (tag, *found.enter(own, barred, hinted)) if own[0] else None
    add(page[at:])
    close()
    return _stood(raw, found, wrappers or wrapper_tree())


#: How a barring element looks: why it bars, its share of the page's running text, its words and the words outside such elements, their
#: ratio, where the page's top heading is (in it 1, elsewhere -1, nowhere 0) and the link density of all in it.
def _wrapper_features(why: int, own: float, left: float, total: float, heading: int, words: float, linked: float) -> list[float]:
    return [why == LISTED, why == KIND, own / max(total, 1), own, left, left / max(left + own, 1), heading, linked / max(words, 1)]


def _stood(raw: list[tuple], found: _Standings, wrappers: Tree) -> list[Block]:
    """Blocks with their standing, after the barring elements that only wrap the article are told from the others.

    Elements are looked at from the outside in: what a wrapper holds itself is text outside barring elements for those in it.
    """
    n = len(found.why)
    sums = np.zeros((n, 4))  # running words, words, linked words, top headings of all in an element
    direct = np.zeros(n)
    left = total = tops = 0.0
    for _, words, linked, barred, _, _, _, top in raw:
        running = words if 2 * linked <= words else 0
        if barred < 0:
            left += running
            total += running
            tops += top
        else:
            sums[barred] += (running, words, linked, top)
            direct[barred] += running
    hidden = np.zeros(n, bool)
    for e in range(n):  # an element comes after the one around it
        hidden[e] = found.why[e] == HIDDEN or found.parent[e] >= 0 and hidden[found.parent[e]]
    inside: dict[int, list[int]] = {}
    for e in range(n - 1, -1, -1):
        if hidden[e]:
            continue
        around = found.parent[e]
        inside.setdefault(around, []).append(e)
        if around >= 0:
            sums[around] += sums[e]
        else:
            total += sums[e][0]
            tops += sums[e][3]
    wraps, ask = np.zeros(n, bool), inside.get(-1, [])
    while ask:
        rows = [_wrapper_features(found.why[e], sums[e][0], left, total, (1 if sums[e][3] else -1) if tops else 0, *sums[e][1:3]) for e in ask]
        chosen = [e for e, p in zip(ask, wrappers.predict(np.array(rows, float)), strict=True) if p > 0.5]
        wraps[chosen] = True
        left += direct[chosen].sum()
        ask = [x for e in chosen for x in inside.get(e, [])]
    return [
        (text, words, linked, BARRED if barred >= 0 and not wraps[barred] else HINTED if hinted >= 0 else FREE, main, kind, hinted if barred < 0 or wraps[barred] else -1)
        for text, words, linked, barred, hinted, main, kind, _ in raw
    ]


# The labelled table of barring elements: why (n named, form or header; l a comment list; k by kind), running words in it,
# outside such elements, and of the page, the top heading (+ in it, - elsewhere, 0 none), words in links, and whether it wraps the article.
LABELLED_WRAPPERS = """
n 300 0 320 + 10 1, n 300 0 300 0 5 1, n 120 12 150 + 2 1, n 90 5 300 0 0 1, n 40 0 45 0 0 1, n 700 20 800 + 30 1, n 60 0 400 - 2 1, n 300 6 310 - 3 1, n 1500 9 1600 - 8 1, n 75 0 80 + 4 1
n 25 0 25 0 0 1, n 30 0 33 + 0 1, n 20 0 26 - 1 1, n 400 30 470 + 9 1, n 130 0 600 0 6 1, n 2000 60 2300 + 40 1, n 34 4 50 + 2 1, n 55 7 66 - 0 1, n 800 0 1700 + 12 1, n 220 0 900 - 5 1
l 400 0 420 + 8 1, l 200 6 260 + 3 1, l 900 15 950 + 20 1, l 60 0 64 + 0 1, k 500 0 500 + 9 1, k 300 4 310 + 2 1, k 900 10 1000 + 30 1, k 90 0 95 + 1 1
n 25 300 340 - 2 0, n 200 90 320 - 0 0, n 900 60 1000 - 4 0, n 900 60 1000 0 4 0, n 150 140 300 0 1 0, n 12 0 320 0 1 0, n 15 0 280 + 3 0, n 30 2 900 0 20 0, n 200 25 225 - 1 0, n 9 0 10 0 0 0
n 8 0 300 + 2 0, n 45 90 150 + 5 0, n 60 400 480 + 6 0, n 16 0 500 0 4 0, n 10 5 200 0 0 0, n 300 40 350 - 2 0, n 80 30 120 - 1 0, n 22 0 700 + 3 0, n 500 35 560 0 6 0, n 5 0 90 - 0 0
l 300 0 300 0 4 0, l 300 120 430 - 2 0, l 80 10 95 - 1 0, l 500 0 500 - 9 0, l 40 60 110 0 0 0, l 700 50 800 + 5 0, l 30 0 200 - 2 0, l 90 0 400 0 3 0
k 60 0 400 0 3 0, k 80 200 300 - 2 0, k 40 0 60 0 5 0, k 30 0 30 0 12 0, k 100 0 130 0 1 0, k 70 0 800 - 6 0, k 50 300 360 + 3 0, k 200 90 300 + 8 0, k 300 0 300 0 4 0, k 25 0 300 + 2 0, k 500 60 600 - 9 0
"""


def labelled_wrappers(table: str = LABELLED_WRAPPERS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's elements."""
    rows, labels = [], []
    for line in table.strip().replace("\n", ",").split(","):
        why, own, left, total, heading, linked, label = line.split()
        own, left, total, linked = map(float, (own, left, total, linked))
        rows.append(_wrapper_features("nlk".index(why), own, left, total, {"+": 1, "-": -1, "0": 0}[heading], own, linked))
        labels.append(float(label))
    return np.array(rows, float), np.array(labels)


# The labelled table, a page a line.  A block: where it stands (- free, m in the main element, h and hm
# hinted, b barred; 2 to 9 tell hinted elements apart), kind of tag (p plain, h heading, i item), words, words in
# links, and whether it is text of the article.
LABELLED = """
b i 1 1 0, b i 2 2 0, b i 1 1 0, h p 8 0 0, m h 9 0 1, m p 70 0 1, m p 2 0 1, m p 120 3 1, m p 1 0 1, b p 9 2 0, b p 5 5 0
b h 3 0 0, b p 14 0 0, m h 5 5 1, m p 4 0 1, m p 35 6 1, m i 6 0 1, m i 3 0 1, m i 9 4 1, m p 250 2 1, hm p 4 0 0, m p 60 0 1, b p 60 0 0, b p 25 1 0
m p 1 0 1, m p 1 0 1, m p 1 0 1, b p 120 0 0, b p 3 0 0
h p 22 1 0, h2 p 40 0 0, m p 14 0 1, m p 5 0 1, m p 33 0 1, hm3 i 5 5 0, hm3 i 6 6 0, hm3 i 4 4 0, b p 80 0 0, b p 45 1 0
- i 1 1 0, - i 1 1 0, - i 2 2 0, - i 1 1 0, - h 4 0 1, - p 5 2 1, - p 80 0 1, - p 4 0 1, - p 110 6 1, - p 65 0 1, - i 4 4 0, - i 6 6 0, - i 5 5 0, - p 5 1 0
- p 4 4 0, - p 3 3 0, - p 2 0 0, - p 5 5 0, - h 3 0 1, - p 45 0 1, - p 7 0 1, - p 52 12 1, - p 9 9 1, - p 60 0 1, - p 12 11 0, - p 9 9 0, - p 2 2 0
- p 6 0 1
- p 40 0 1, - p 3 0 1, - p 5 0 1
- h 5 0 1, - p 30 0 1, - h 3 0 1, - p 36 0 1, - i 8 0 1, - i 11 1 1, - i 5 0 1, - p 28 0 1
h h 7 0 1, h p 3 0 1, h p 90 1 1, h p 1 0 1, h p 140 4 1, h p 20 0 1, h i 7 0 1, h i 4 0 1, h p 75 0 1, b p 12 3 0, b i 2 2 0
b i 3 3 0, h2 p 55 0 1, h2 p 130 2 1, h2 p 2 0 1, h2 h 6 0 1, h2 p 64 0 1, h3 p 15 1 0, h4 i 6 6 0, h4 i 8 8 0, h4 i 5 5 0
h p 18 2 0, - h 9 0 1, - p 75 1 1, - p 62 0 1, h2 p 6 0 0, h2 p 11 1 0, - p 88 0 1, h3 h 2 0 0, h3 p 7 7 0, h3 p 9 9 0, b p 70 0 0, b p 110 2 0
h p 30 1 0, h p 24 2 0, - p 48 0 1, - p 95 3 1, - p 3 0 1, - p 70 0 1, h2 p 35 1 0, h2 p 12 3 0
- p 20 0 0, - p 60 1 0, m h 7 0 1, m p 150 2 1, m p 90 0 1, - i 3 3 0, - i 2 0 0, - p 9 0 0, - p 4 0 0
- p 12 0 0, - h 2 0 0, - i 6 6 0, m h 8 0 1, m p 12 12 1, m p 45 0 1, m p 80 20 1, m p 6 6 1, m p 44 0 1, - p 26 1 0
m p 60 0 1, m p 3 3 1, m p 70 0 1, m p 55 0 1, m i 4 4 0, m i 5 5 0, m i 3 3 0, m i 6 6 0
b i 2 2 0, m h 6 0 1, m p 300 4 1, m p 2 0 1, m i 2 0 1, m i 1 0 1, m i 3 1 1, m i 1 0 1, hm p 20 1 0, hm p 9 2 0, m p 36 0 1
- i 1 1 0, - i 1 0 0, - i 2 2 0, - i 1 1 0, - p 95 0 1, - h 4 0 1, - p 120 2 1, - p 2 0 1, - p 58 1 1, - p 3 3 0, - i 2 2 0, - i 1 1 0
h p 20 0 0, - h 7 0 1, - p 66 0 1, - p 90 1 1, h2 p 8 0 0, - p 55 0 1, h3 p 28 0 0, h3 p 31 0 0
h p 35 0 0, h2 p 14 0 0, - p 72 0 1, - p 5 0 1, - p 101 0 1, h3 p 40 0 0, h3 p 3 0 0, b p 30 0 0
h i 40 39 0, h i 66 60 0, h i 80 76 0, - h 6 0 1, - p 85 0 1, - p 64 1 1, - p 1 0 1, - p 77 2 1
m h 5 0 1, m p 140 0 1, m p 230 1 1, h p 110 1 0, h p 90 0 0, h i 3 0 0
b i 1 1 0, - h 2 0 1, - p 60 0 1, - p 62 1 1, b p 12 0 0, b p 180 0 0, b p 5 0 0
b i 1 1 0, - h 3 0 1, - p 45 0 1, - p 130 2 1, b p 9 0 0, - p 1 1 0
b p 50 0 0, b p 200 1 0, b p 2 0 0, m p 22 0 1, m p 8 0 1, m p 48 2 1, b h 2 0 0, b p 33 0 0, b p 66 0 0
"""


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.nodes: list[tuple[int, float, int, int, float]] = []  # feature, cut, left, right, value
        self._grow(x, y)

    def _grow(self, x: np.ndarray, y: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, float(y.mean())))
        if y.min() == y.max():
            return me
        best = (np.inf, -1, 0.0)
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            for cut in (v[1:] + v[:-1]) / 2:
                left = y[x[:, f] <= cut]
                right = y[x[:, f] > cut]
                gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (left, right))
                if gini < best[0] - 1e-12:
                    best = (gini, f, cut)
        _, f, cut = best
        if f >= 0:
            go = x[:, f] <= cut
            left, right = self._grow(x[go], y[go]), self._grow(x[~go], y[~go])
            self.nodes[me] = (f, cut, left, right, float(y.mean()))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right, value = (np.array(c) for c in zip(*self.nodes, strict=True))
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            k = at[inner]
            at[inner] = np.where(x[inner, feature[k]] <= cut[k], left[k], right[k])
        return value[at]


def block_features(blocks: list[Block]) -> np.ndarray:
    """A row of numbers for each block of one page.

    Words and link density of the block, of the one before and of the one after; standing; in main; the page has a main
    element; kind of tag; words of the hinted element and its link density.
    """
    n = np.array([b[1] for b in blocks], float)
    linked = np.array([b[2] for b in blocks], float)
    density = linked / np.maximum(n, 1)
    standing, main, kind, element = (np.array([b[k] for b in blocks], float) for k in (3, 4, 5, 6))
    before, after = (lambda v: np.append(0, v[:-1])), (lambda v: np.append(v[1:], 0))
    # a main element counts if it holds half of the page's running text at least, so a mere teaser does not
    text = np.where((standing == FREE) & (density <= 0.5), n, 0)
    inside = (standing == FREE) & (main == 1)
    has_main = np.full(len(blocks), float(inside.any() and 2 * text[inside].sum() >= text.sum()))
    hinted = standing == HINTED
    _, at = np.unique(element, return_inverse=True)
    held, held_links = (np.where(hinted, np.bincount(at, weights=v)[at], 0) for v in (n, linked))
    return np.column_stack([n, density, before(n), before(density), after(n), after(density), standing, main, has_main, kind, held, held_links / np.maximum(held, 1)])


def labelled_pages(table: str = LABELLED) -> tuple[list[list[Block]], np.ndarray]:
    """Blocks of the table's pages, without texts, and all their labels."""
    found, labels = [], []
    for line in table.strip().splitlines():
        page = []
        for block in line.split(","):
            where, kind, n, linked, label = block.split()
            standing = HINTED if "h" in where else BARRED if "b" in where else FREE
            element = int("0" + "".join(filter(str.isdigit, where))) if standing == HINTED else -1
            page.append(("", int(n), int(linked), standing, "m" in where, {"p": PLAIN, "h": HEADING, "i": ITEM}[kind], element))
            labels.append(int(label))
        found.append(page)
    return found, np.array(labels, float)


@functools.cache
def wrapper_tree() -> Tree:
    return Tree(*labelled_wrappers())


@functools.cache
def default_tree() -> Tree:
    found, labels = labelled_pages()
    return Tree(np.concatenate([block_features(p) for p in found]), labels)


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """Main text of each page; empty if the page is null or has no such block."""
    found = [text_blocks(p or "") for p in pages]
    rows = [block_features(b) for b in found if b]
    keep = iter(tree.predict(np.concatenate(rows)) > 0.5 if rows else ())
    return ["\n".join([b[0] for b in blocks if next(keep)]) for blocks in found]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """Per row of ``pages``: id, url, ``text`` and ``n_chars``, its code points.

    Null and empty pages, and those without a block of the article, have an empty text.  Broken markup is read as far
    as it goes: a tag without an end is text, an unclosed comment or script ends with the page.  Pages of any
    length are read whole, in linear time.  Rows are independent, so repeated rows get equal results; other
    columns are left alone, whatever their names, and an empty table gives an empty result.
    """
    tree = tree or default_tree()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for batch in batches:
            texts = main_texts(batch.column(2).to_pylist(), tree)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint"
    )
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
