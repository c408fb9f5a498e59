"""Plain versions that the operators are tested against."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def repeats(words, n):
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    mark = [False] * len(words)
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            mark[i : i + n] = [True] * n
    return mark


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(t, n=4):
    w = WORD.findall(fold(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def without_repeats(rows, width=13):
    """rows: (id, text); ids None sort last."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, rank(i)), rank(i))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < rank(i):
                gone[k : k + width] = [True] * width
        yield i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


def plain_targets(size: dict) -> dict:
    """Words each source is to give: by weights 5, 2, 1, at most three times its size, the excess shared again."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        left, free = left - sum(3 * size[s] for s in over), free - over
    return target
