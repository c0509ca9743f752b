"""SentencePiece encoding and decoding as shortest paths of weighted transducers.

The model file is compiled into three machines: a normaliser (dummy prefix, spaces to the
space mark), a transducer from characters to pieces, and byte fallback for characters without
a piece. An input is composed with them into a lattice over its characters, and the tropical
shortest path gives the pieces.

* Unigram models: a piece's arc costs minus its score; byte fallback costs more than any piece.
* BPE models: their order of merges is no sum of scores. A segmentation is the merges' result
  exactly if each two neighbours, merged on their own, stay those two pieces: a merge that
  crosses a boundary would be the first to do so, and would then show in that pair. So the
  piece machine is composed with an acceptor of neighbours, whose arcs cost nothing where the
  pair is stable and are infinite elsewhere. One path stays finite.

No piece crosses the start of a run of space marks, nor a character that no longer piece
holds; there the lattice has a cut vertex, so that shortest paths of the parts, each computed
once per distinct part, make up the whole one.

Defined results: null and empty texts have no ids. A space mark in a text is read as a space,
as the format has it; every other text decodes to itself. Rows repeat as given. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .words import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
FALLBACK_COST = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """What a model file says: pieces with scores and kinds, model type, normaliser."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe = self.suffix_marks = self.trims = False
        self.dummy_prefix = True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.bpe, self.suffix_marks = own.get(3, 1) == 2, bool(own.get(24, 0))
                if own.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models have a lattice of pieces")
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a character map are not supported; identity ones are")
                self.dummy_prefix, self.trims = bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.suffix_marks or USER in self.kinds:
            raise ValueError("suffix space marks and user-defined pieces are not supported")


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, path: str, cached: int = 300_000) -> None:
        model = self.model = Model(path)
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] in (NORMAL, UNUSED)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        # Parts: a run of marks with the word behind it; a line break alone if no piece holds it.
        self.line_breaks = "\n" not in inner
        word = f"[^{MARK}\n]" if self.line_breaks else f"[^{MARK}]"
        self.parts = re.compile(f"{MARK}*{word}+|{MARK}+|\n")
        # The piece machine: prefixes of pieces are its states.
        # A state maps a character to the next state, and "" to itself where a piece ends.
        self.states: dict = {}
        for piece in self.ids:
            state = self.states
            for c in piece:
                state = state.setdefault(c, {})
            state[""] = state
        self.stable: dict[str, dict[str, bool]] = {}
        self.histories: dict[str, list | None] = {}
        self.pairs = 0
        # Outputs of parts, in two generations so that a full cache loses only what is unused.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = cached
        self.plain = [p.replace(MARK, " ").encode() for p in model.pieces]
        for value, i in self.bytes.items():
            self.plain[i] = bytes([value])
        for i, kind in enumerate(model.kinds):
            if kind == CONTROL:
                self.plain[i] = b""
        self.plain[self.unknown] = " ⁇ ".encode()

    def normalised(self, text: str) -> str:
        if self.model.trims:
            text = re.sub(" +", " ", text.replace(MARK, " ")).strip(" ")
        text = text.replace(" ", MARK)
        return MARK + text if text and self.model.dummy_prefix else text

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """All merges of ``text``, best score first, then leftmost: the symbols left, and for
        each merge its score and the first and last symbol after it."""
        symbols, done, scores = list(text), [], self.model.scores
        while len(symbols) > 1:
            best, at = -math.inf, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and scores[piece] > best:
                    best, at = scores[piece], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            done.append((best, symbols[0], symbols[-1]))
        return symbols, done

    def history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece from its characters; null if others come first."""
        if piece not in self.histories:  # pieces and single characters
            symbols, done = self.merges(piece)
            self.histories[piece] = done if symbols == [piece] else None
        return self.histories[piece]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the pair acceptor has a finite arc; ``a`` is empty at the start."""
        own = self.stable.get(a)
        if own is None:
            own = self.stable[a] = {}
        found = own.get(b)
        if found is None:
            self.pairs += 1
            if self.pairs > 4 * self.cached:
                self.stable.clear()
                self.pairs, own = 0, self.stable.setdefault(a, {})
            found = own[b] = self.history(b) is not None and (not a or self.stays_apart(a, b))
        return found

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether no merge crosses the boundary while both pieces are merged side by side."""
        left, right = self.history(a), self.history(b)
        if left is None or right is None:
            return False
        x, y, i, j = a[-1], b[0], 0, 0
        while True:
            crossing = self.ids.get(x + y)
            mine = left[i][0] if i < len(left) else -math.inf
            theirs = right[j][0] if j < len(right) else -math.inf
            if crossing is not None:
                score = self.model.scores[crossing]
                if score > mine and score >= theirs:
                    return False
            if i == len(left) and j == len(right):
                return True
            if mine >= theirs and i < len(left):
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def arcs(self, text: str, at: int) -> list[int]:
        """Ends of the piece machine's arcs from a position; single characters always have
        one, by byte fallback if need be."""
        ends = [at + 1]
        state = self.states.get(text[at])
        if state is not None:
            for end in range(at + 2, len(text) + 1):
                state = state.get(text[end - 1])
                if state is None:
                    break
                if "" in state:
                    ends.append(end)
        return ends

    def shortest(self, text: str) -> list[str]:
        """The tropical shortest path through the lattice of one part."""
        return self.finite_path(text) if self.model.bpe else self.cheapest_path(text)

    def cheapest_path(self, text: str) -> list[str]:
        """Positions in order: the lattice has no cycle."""
        scores = self.model.scores
        fallback = FALLBACK_COST - min(scores)
        cost, back = [math.inf] * (len(text) + 1), [0] * (len(text) + 1)
        cost[0] = 0.0
        for at in range(len(text)):
            for end in self.arcs(text, at):
                i = self.ids.get(text[at:end])
                total = cost[at] + (fallback if i is None else -scores[i])
                if total < cost[end]:
                    cost[end], back[end] = total, at
        path, at = [], len(text)
        while at:
            path.append(text[back[at] : at])
            at = back[at]
        return path[::-1]

    def finite_path(self, text: str) -> list[str]:
        """All arcs cost nothing or are infinite, and of the finite paths to a position there is
        one at most: so the first path that arrives is the shortest, and a position that led
        nowhere is not tried again. Longest pieces first."""
        n, at, before = len(text), 0, ""
        path: list[str] = []
        todo = [self.arcs(text, 0)]
        seen = set()
        stable = self.stable
        while at < n:
            ends = todo[-1]
            while ends:
                end = ends.pop()
                if end in seen:
                    continue
                piece = text[at:end]
                try:
                    fits = stable[before][piece]
                except KeyError:
                    fits = self.neighbours(before, piece)
                if fits:
                    seen.add(end)
                    before = piece
                    path.append(piece)
                    at = end
                    if at < n:
                        todo.append(self.arcs(text, at))
                    break
            else:
                todo.pop()
                at -= len(path.pop())
                before = path[-1] if path else ""
        return path

    def outputs(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.shortest(part):
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return array("i", ids).tobytes()

    def word(self, word: str) -> bytes:
        """Outputs of a mark and a word."""
        found = self.older.get(word)
        if found is None:
            found = b"".join(map(self.outputs, self.parts.findall(MARK + word)))
        if len(word) < 64:
            if len(self.known) > self.cached:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        text = self.normalised(text)
        if text[:1] != MARK or text[-1:] == MARK or MARK + MARK in text:
            return b"".join(map(self.outputs, self.parts.findall(text)))
        words = text[1:].split(MARK)  # each with one mark before it
        out = list(map(self.known.get, words))
        if None in out:
            known = self.known
            out = [known.get(w) or self.word(w) if x is None else x for x, w in zip(out, words)]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The inverse machine: pieces to text."""
        data = b"".join(map(self.plain.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(2)
def transducer(path: str) -> Transducer:
    """Compiled once per worker."""
    return Transducer(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in slices(batches, 1):
            found = [machine.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.record_batch([batch.column(0), ids], ["key", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            found = batch.column(1)
            ends, values = found.offsets.to_numpy(), found.values.to_numpy()
            spans = zip(ends[:-1], ends[1:], found.is_valid().to_pylist())
            texts = [machine.decode(values[a:b]) if valid else None for a, b, valid in spans]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "ids", "text"])

    return run


def encode_texts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of piece ids) of every row."""
    rows = prepare(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_encode(model_file), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and the ``text`` they stand for; null ids have a null text."""
    rows = prepare(encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_decode(model_file), f"key {kind}, ids array<int>, text string")
    return out.select(F.col("key").alias(key), "ids", "text")
