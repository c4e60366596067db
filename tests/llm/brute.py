"""Plain single-machine versions of the operators' contracts."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=True):
    text = text or ""
    return WORD.findall(text.translate(FOLD) if fold else text)


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows):
    """{id: (set size, smallest linked id)} of (id, text) rows."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    near = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in near:
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}
