"""Brute-force versions that several tests use."""

import re
from itertools import combinations

import numpy as np


def brute_components(rows, size, percent):
    """The smallest reachable id of each (id, text)."""

    def grams(t):
        w = re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        w = [x for x in w if x]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [(i, grams(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        both = len(x & y)
        if both and 100 * both >= percent * (len(x) + len(y) - both):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: top(i) for i in up}


def plain_words(t):
    return re.sub("[\x00-\x2f:-@\\[-`{-\x7f]", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")).split(" ")


def brute_overlaps(doc, item, enough=10, miss=2, share=0.75):
    """Whether the best segment over all diagonals is enough."""
    a, b = (np.array([w for w in plain_words(t) if w], object) for t in (doc, item))
    best, run = 0, np.zeros(len(a) + 1, int)
    for w in b:
        run[1:] = np.maximum(0, run[:-1] + np.where(a == w, 1, -miss))
        run[0] = 0
        best = max(best, run.max())
    return best > 0 and best >= min(enough, np.ceil(share * len(b)))


def brute_leaks(rows, items):
    return {i for i, t in rows if any(brute_overlaps(t, x) for x in items)}
