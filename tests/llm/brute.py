"""Plain Python versions to compare with."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def classes(ids, links) -> dict:
    """The smallest id that each id reaches."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def similar_pairs(sets: dict, percent: int = 75):
    """All pairs of keys with 100 * intersection >= percent * union, by an inverted index."""
    holders: dict = {}
    for key, found in sets.items():
        for s in found:
            holders.setdefault(s, []).append(key)
    shared: dict = {}
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            yield a, b
