"""Hashes of words and shingles of whole texts, computed for many texts at once with numpy.

Words are the runs outside ASCII white space, with A-Z lower-cased. Hashes have 64 bits; equal
words always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed so far."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))
                for x in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


_POWERS = {BASE: _Powers(BASE)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(values: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P of bytes times powers, and inverse powers D: the hash of [s, e) is
    (P[e] - P[s]) * D[s]."""
    powers = _POWERS.setdefault(base, _Powers(base))
    up, down = powers.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return prefix, down


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts (column ``text``) have about ``limit`` bytes at
    most, so that a task's arrays stay small. A longer text is a run of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
        if not batch.num_rows:
            yield batch


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of ``data``."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans in ascending order."""
    values, out = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        first = starts[i]
        prefix, down = prefix_hashes(values[first : ends[j - 1]])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (prefix[e] - prefix[s]) * down[s]
        i = j
    return mix(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts in order: hash, start and end in the joined bytes (one space
    between texts); and the number of words of each text."""
    data = b" ".join(texts).lower()
    starts, ends = word_spans(data)
    out = span_hashes(data, starts, ends)
    text_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return out, starts, ends, counts


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, by its first word."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : n + j]
    return mix(out)


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of ``width`` words. A shorter text is one
    run; a text without words has none."""
    runs = sequence_hashes(words, width)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= width:
            sets.append(np.unique(runs[at : at + n - width + 1]))
        else:
            sets.append(sequence_hashes(words[at : at + n], n) if n else runs[:0])
        at += n
    return sets


def minhash_parameters(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    state = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))
    return state[:size] | np.uint64(1), state[size:]


def minhash(values: np.ndarray, parameters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """32-bit minima of the set under each hash function of ``parameters``."""
    a, b = parameters
    best = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(values), 4096):
        part = values[i : i + 4096, None] * a + b
        best = np.minimum(best, (part >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return best


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes, as two signed numbers."""
    one = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = mix(values + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))
