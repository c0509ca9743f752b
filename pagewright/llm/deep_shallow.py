"""Suffix sorting in two steps: a multikey quicksort to a shallow depth, and blind tries for the
groups that still share a longer prefix.

The quicksort's characters are blocks of eight bytes, and one pass partitions all groups of a
depth at once; so its cost per suffix is a few vector operations. What is still equal then
tends to be equal for long: a blind trie inserts each suffix with one comparison of whole
suffixes, however long the common prefix.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


class BlindTrie:
    """A trie over branching positions only. A node is [position, {byte: child}]; a leaf is
    the number of a string. A string that ends at the position has the byte -1."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None

    @staticmethod
    def _byte(string: bytes, at: int) -> int:
        return string[at] if at < len(string) else -1

    def insert(self, one: int) -> None:
        text = self.strings[one]
        if self.root is None:
            self.root = one
            return
        node = self.root  # blind search: looks at branching bytes only
        while isinstance(node, list):
            node = node[1].get(self._byte(text, node[0]), next(iter(node[1].values())))
        common = shared_prefix(text, self.strings[node])  # the one comparison
        node, parent, edge = self.root, None, None
        while isinstance(node, list) and node[0] < common:
            parent, edge = node, self._byte(text, node[0])
            node = parent[1][edge]
        mine = self._byte(text, common)
        if isinstance(node, list) and node[0] == common:
            node[1][mine] = one
            return
        other = node
        while isinstance(other, list):
            other = next(iter(other[1].values()))
        fork = [common, {self._byte(self.strings[other], common): node, mine: one}]
        if parent is None:
            self.root = fork
        else:
            parent[1][edge] = fork

    def sorted(self) -> list[tuple[int, int]]:
        """Strings in order, with the prefix each shares with the one before (0 at first)."""
        out: list[tuple[int, int]] = []
        todo: list[tuple[object, int]] = [(self.root, 0)]
        while todo:
            node, common = todo.pop()
            if isinstance(node, list):
                children = sorted(node[1].items(), reverse=True)
                todo += [(child, node[0]) for _, child in children[:-1]] + [(children[-1][1], common)]
            else:
                out.append((node, common))
        return out


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:  # a[:low] == b[:low], a[:high] != b[:high]
        middle = (low + high) // 2
        if a[low : middle + 1] == b[low : middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


def sort_distinct(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct strings by group and then bytewise, and the prefix that each shares
    with the one before it in that order (-1 at the start of a group). No group holds a string
    twice."""
    n = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    order = np.argsort(group, kind="stable")
    common = np.zeros(n, np.int64)
    segment = np.ones(n, bool)  # where a segment of equal prefixes starts
    segment[1:] = group[order][1:] != group[order][:-1]
    common[segment] = -1
    weight = (np.uint64(1) << np.arange(56, -1, -8, dtype=np.uint64))[None, :]
    for depth in range(0, SHALLOW, 8):
        number = np.cumsum(segment) - 1
        alone = np.bincount(number)[number] == 1
        at = np.flatnonzero(~alone)
        if not len(at):
            return order, common
        mine = order[at]
        left = np.clip(sizes[mine] - depth, 0, 8)
        place = starts[mine, None] + np.minimum(depth, sizes[mine, None]) + np.arange(8)
        block = np.where(np.arange(8) < left[:, None], data[np.minimum(place, len(data) - 1)], 0)
        word = (block.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)
        ranked = np.lexsort((left, word, number[at]))
        order[at], word, left, block = mine[ranked], word[ranked], left[ranked], block[ranked]
        same_segment = ~segment[at]
        differs = np.zeros(len(at), bool)
        differs[1:] = same_segment[1:] & ((word[1:] != word[:-1]) | (left[1:] != left[:-1]))
        first = np.argmax(np.hstack([block[1:] != block[:-1], np.ones((len(at) - 1, 1), bool)]), axis=1)
        equal = np.minimum(first, np.minimum(left[1:], left[:-1])) if len(at) > 1 else np.zeros(0, int)
        cut = np.flatnonzero(differs)
        common[at[cut]] = depth + equal[cut - 1]
        segment[at[cut]] = True
    number = np.cumsum(segment) - 1
    heads = np.flatnonzero(segment)
    for k in np.flatnonzero(np.bincount(number) > 1):
        first, last = heads[k], heads[k + 1] if k + 1 < len(heads) else n
        trie = BlindTrie(strings)
        for one in order[first:last].tolist():
            trie.insert(one)
        ranked = trie.sorted()
        order[first:last] = [x for x, _ in ranked]
        common[first + 1 : last] = [c for _, c in ranked[1:]]
    return order, common


def prefix_classes(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings that may repeat: each one's place among the distinct strings of all groups in
    order, their shared prefixes, and their lengths. Strings of a group agree to depth d exactly
    if no shared prefix between their places is shorter."""
    known: dict[tuple[int, bytes], int] = {}
    mine = np.array([known.setdefault(key, len(known)) for key in zip(group.tolist(), strings)], np.int64)
    distinct = [text for _, text in known]
    groups = np.array([g for g, _ in known], np.int64)
    order, common = sort_distinct(distinct, groups)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[mine], common, np.array([len(s) for s in strings], np.int64)
