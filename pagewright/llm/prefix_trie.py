"""The trie of conversation prefixes, from sorted paths and range minima.

A conversation is a path of turn digests. Distinct paths are sorted over the whole table and cut
into blocks of bounded size. Inside a block, the number of turns that each path shares with the
one before it (LCP) is known, and a sparse table gives the minimum of any range. A prefix is a
path and a depth; its members are the widest range around the path whose minimum is not below
the depth, and both ends are found by binary search, each on its own: no stack, no order among
prefixes. All figures of a node are sums, minima or counts over that range.

A prefix that reaches over the edge of its block has a part in each block. The parts are added
up by the digest of the prefix, so a first turn that opens a third of all conversations is spread
over many tasks and one short row per block is gathered. Texts are read once, to be digested.

Defined results: rows without ``conv_id`` belong to no conversation and are left out. Turns are
ordered by ``turn`` (null first); equal places by digest of role and text. Repeated rows are
repeated turns. A null role or text is empty. ``conv_id % 100`` has the sign of ``conv_id``. An
empty table has no node, not even a root. Other columns are ignored.

Bounds: one conversation is one row of 20 bytes a turn. The ids of conversations that are equal
throughout are hashed one after another, as the digest asks, in pieces made by other tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

CELL = 20  # bytes of a turn in a path: 16 of digest, 4 of its text's length
NO_IDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    """``block_bytes``: paths of a block; ``chunk_ids``: ids joined into one piece."""

    block_bytes: int = 16 << 20
    chunk_ids: int = 1 << 16


def turn_cells(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id``, ``cells``: the turns of each conversation in order, in hexadecimal."""
    rows = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    told = F.md5(F.concat(F.length("role").cast("string"), F.lit(","), "role", "text").cast("binary"))
    cell = F.concat(told, F.lpad(F.hex(F.length("text")), 8, "0"))
    rows = rows.select("conv_id", F.struct("turn", cell.alias("cell")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.cell").alias("cells"))


def shared_heads(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Rebuild conversations: the first h turns of the first one of the group, then the own
    turns after the first h, h = crc32(conv_id) mod ``most``. Returns ``conv_id``, ``path``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = conversations.select("conv_id", "cells", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = conversations.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("cells", 1, most - 1).alias("head")
    )
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("cells", F.col("h") + 1, F.greatest(F.size("cells"), F.lit(1)))
    cells = F.concat(head, rest)
    return own.join(heads, "base", "left").select("conv_id", F.unhex(F.array_join(cells, "")).alias("path"))


def _pieces(most: int):
    """Rows key, conv_id in order to key, first, n, ids (joined by commas)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and end - at < most:
                    end += 1
                out.append((keys[at], ids[at], end - at, ",".join(map(str, ids[at:end])).encode()))
                at = end
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "first", "n", "ids"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, first, n, ids in order to key, conv_id, n, ends_sha256."""
    key, first, n, told = None, 0, 0, None
    out: list[tuple] = []

    def found() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "conv_id", "n", "ends_sha256"])

    for batch in batches:
        for k, f, more, ids in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if k == key:
                n += more
                told.update(b"," + ids)
            else:
                if told is not None:
                    out.append((key, first, n, told.hexdigest()))
                key, first, n, told = k, f, more, hashlib.sha256(ids)
        yield found()
    if told is not None:
        out.append((key, first, n, told.hexdigest()))
    yield found()


def distinct_paths(rebuilt: DataFrame, cfg: Trie) -> DataFrame:
    """Each path once: ``path``, ``conv_id`` (smallest), ``n`` (conversations), ``ends_sha256``."""
    keyed = rebuilt.select(F.unhex(F.md5("path")).alias("key"), "conv_id")
    # By ranges of key and id, so that many copies of one conversation lie in many tasks.
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ordered.mapInArrow(_pieces(cfg.chunk_ids), "key binary, first bigint, n bigint, ids binary")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "first")
    ends = pieces.mapInArrow(_digests, "key binary, conv_id bigint, n bigint, ends_sha256 string")
    return rebuilt.join(ends.select("conv_id", "n", "ends_sha256"), "conv_id")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, low, high, before, after to block, left, right: turns that the first path
    shares with the last one of the block before, and the last with the next first; -1: none."""

    def shared(a: bytes, b: bytes | None) -> int:
        if b is None:
            return -1
        n = min(len(a), len(b)) // CELL
        one, two = (np.frombuffer(x, np.uint8, n * CELL).reshape(n, CELL) for x in (a, b))
        other = np.flatnonzero((one != two).any(axis=1))
        return int(other[0]) if len(other) else n

    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in range(5))))
        out = [(b, shared(low, before), shared(high, after)) for b, low, high, before, after in rows]
        columns = list(zip(*out)) or [()] * 3
        yield pa.record_batch([pa.array(c, pa.int32()) for c in columns], ["block", "left", "right"])


class RangeMinimum:
    """Minimum of any range of an array, by a table of minima over powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.table = [values]
        while len(values) > (step := 1 << (len(self.table) - 1)):
            values = np.minimum(values[:-step], values[step:])
            self.table.append(values)

    def minimum(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.table[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][first[at]], self.table[k][last[at] + 1 - (1 << int(k))])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place r such that no value in (at, r] is below ``least``."""
        at = at.copy()
        for k in reversed(range(len(self.table))):
            row = self.table[k]
            fits = at + 1 < len(row)
            fits[fits] = row[at[fits] + 1] >= least[fits]
            at[fits] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place l such that no value in (l, at] is below ``least``."""
        at = at.copy()
        for k in reversed(range(len(self.table))):
            first = at - (1 << k) + 1
            fits = first > 0
            fits[fits] = self.table[k][first[fits]] >= least[fits]
            at[fits] -= 1 << k
        return at


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Block:
    """Consecutive distinct paths, and what they share with the blocks around them."""

    def __init__(self, paths: list[bytes], ids: list[int], counts: list[int], left: int, right: int) -> None:
        self.paths, self.left, self.right = paths, left, right
        self.size = np.array([len(p) // CELL for p in paths], np.int64)
        self.start = np.cumsum(self.size) - self.size
        cells = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, CELL)
        one, two = (np.ascontiguousarray(cells[:, a : a + 8]).view(np.uint64).ravel() for a in (0, 8))
        # Code points before each turn, per path, and of the whole path.
        length = np.ascontiguousarray(cells[:, 16:]).view(">u4").ravel().astype(np.int64)
        self.chars = np.concatenate([[0], np.cumsum(length)])
        self.total = self.chars_to(np.arange(len(paths)), self.size)
        self.lcp = self._shared(one, two)
        self.lcp[0] = left
        self.ranges = RangeMinimum(self.lcp)
        self.smallest = RangeMinimum(np.array(ids, np.int64))
        after = np.append(self.lcp[1:], right)
        introduced = self.total - self.chars_to(np.arange(len(paths)), np.maximum(self.lcp, 0))
        n = np.array(counts, np.int64)
        self.n, self.leaves, self.new, self.weighted = (
            np.concatenate([[0], np.cumsum(x)]) for x in (n, after < self.size, introduced, n * self.total)
        )
        # Places of each LCP value, to count one value in a range.
        self.by_value = np.sort(np.maximum(self.lcp, 0) * len(paths) + np.arange(len(paths)))

    def chars_to(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.chars[self.start[row] + depth] - self.chars[self.start[row]]

    def _shared(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        lcp = np.zeros(len(self.size), np.int64)
        both = np.minimum(self.size[1:], self.size[:-1])
        if len(both) and both.sum():
            depth = _runs(both)
            a, b = np.repeat(self.start[:-1], both) + depth, np.repeat(self.start[1:], both) + depth
            other = np.where((one[a] == one[b]) & (two[a] == two[b]), np.repeat(both, both), depth)
            some = both > 0
            lcp[1:][some] = np.minimum.reduceat(other, (np.cumsum(both) - both)[some])
        return lcp

    def with_value(self, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How often ``value`` is an LCP at the places first to last."""
        m = len(self.paths)
        up = np.searchsorted(self.by_value, value * m + last, "right")
        return up - np.searchsorted(self.by_value, value * m + first, "left")

    def nodes(self) -> dict[str, np.ndarray]:
        """All prefixes with members here: those that begin here, and those of the first path
        that began before."""
        fresh = self.size - self.lcp
        row = np.concatenate([np.repeat(np.arange(len(fresh)), fresh), np.zeros(self.left + 1, np.int64)])
        depth = np.concatenate([_runs(fresh) + np.repeat(self.lcp + 1, fresh), np.arange(self.left + 1)])
        first, last = self.ranges.left(row, depth), self.ranges.right(row, depth)
        begins = depth > self.lcp[row]
        n = self.n[last + 1] - self.n[first]
        above = np.maximum(depth - 1, 0)
        # Turns of all members, less one copy of each distinct one.
        every = self.weighted[last + 1] - self.weighted[first] - n * self.chars_to(row, above)
        once = self.new[last + 1] - self.new[first]
        once += np.where(begins, self.chars_to(row, np.maximum(self.lcp[row], 0)) - self.chars_to(row, above), 0)
        children = self.with_value(depth, first + 1, last)
        children += (self.size[row] > depth) & (begins | (depth == self.left))
        up_first, up_last = self.ranges.left(row, above), self.ranges.right(row, above)
        return {
            "row": row,
            "depth": depth,
            "conv_id": self.smallest.minimum(first, last),
            "n_convs": n,
            "n_children": children,
            "n_leaves": self.leaves[last + 1] - self.leaves[first],
            "saved_tokens": every - once,
            "side": self._side(first, last, depth),
            "parent": self.smallest.minimum(up_first, up_last),
            "parent_side": np.where(depth > 0, self._side(up_first, up_last, above), -1),
            "ends": depth == self.size[row],
        }

    def _side(self, first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """0: a prefix of the first path that began before; 1: one of the last path that goes
        on; -1: all members are here."""
        before = (first == 0) & (depth <= self.left)
        return np.where(before, 0, np.where((last == len(self.paths) - 1) & (depth <= self.right), 1, -1))

    def keys(self) -> tuple[list[bytes], list[bytes]]:
        """Digests of the prefixes that reach over either edge, by depth."""
        return _prefix_digests(self.paths[0], self.left), _prefix_digests(self.paths[-1], self.right)


def _prefix_digests(path: bytes, most: int) -> list[bytes]:
    told, out = hashlib.md5(), []
    for depth in range(most + 1):
        told.update(path[CELL * (depth - 1) : CELL * depth] if depth else b"")
        out.append(told.digest())
    return out


NODE = (
    "block int, key binary, parent_key binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, parent_conv_id bigint, ends_sha256 string"
)
_KINDS = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
_NAMES = [part.split()[0] for part in NODE.split(", ")]


def _nodes_of(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    paths, ids, counts, ends, left, right = zip(*rows)
    here = Block(list(paths), list(ids), list(counts), left[0], right[0])
    found = here.nodes()
    row, depth = found["row"], found["depth"]
    by_side = here.keys()

    def keys(side: np.ndarray, of: np.ndarray) -> list[bytes | None]:
        return [by_side[s][d] if s >= 0 else None for s, d in zip(side.tolist(), of.tolist())]

    own, above = keys(found["side"], depth), keys(found["parent_side"], depth - 1)
    no_parent = (found["parent_side"] >= 0) | (depth == 0)
    told = [ends[r] if e else None for r, e in zip(row.tolist(), found["ends"].tolist())]
    columns = [
        pa.array(np.full(len(row), block, np.int32)), pa.array(own, pa.binary()), pa.array(above, pa.binary()),
        *(pa.array(found[c], pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
        pa.array(found["parent"], pa.int64(), mask=no_parent), pa.array(told, pa.string()),
    ]
    table = pa.Table.from_arrays(columns, _NAMES)
    yield from table.to_batches(max_chunksize=1 << 16)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, path, conv_id, n, ends_sha256, left, right in order to the parts of nodes."""
    block, rows = None, []
    for batch in batches:
        for b, *rest in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if b != block:
                if rows:
                    yield from _nodes_of(block, rows)
                block, rows = b, []
            rows.append(tuple(rest))
    if rows:
        yield from _nodes_of(block, rows)


def trie_nodes(paths: DataFrame, cfg: Trie = Trie()) -> DataFrame:
    """One row per prefix of ``paths`` (from ``distinct_paths``): ``conv_id``, ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``."""
    paths = stored(paths, "paths")
    total = paths.agg(F.sum(F.octet_length("path") + 32)).first()[0] or 0
    ordered = paths.repartitionByRange(max(1, -(-total // cfg.block_bytes)), "path")
    ordered = stored(ordered.withColumn("block", F.spark_partition_id()), "sorted-paths")
    ends = ordered.groupBy("block").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    # One row per block.
    by_block = Window.orderBy("block")
    around = ends.select("block", "low", "high", F.lag("high").over(by_block).alias("before"), F.lead("low").over(by_block).alias("after"))
    edges = stored(around.mapInArrow(_edges, "block int, left int, right int"), "edges")
    rows = ordered.join(edges, "block").select("block", "path", "conv_id", "n", "ends_sha256", "left", "right")
    rows = rows.repartition("block").sortWithinPartitions("block", "path")
    parts = stored(rows.mapInArrow(_blocks, NODE), "parts")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    split = parts.filter("key is not null")
    whole = split.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in figures), F.max("ends_sha256").alias("ends_sha256"),
    )
    whole = stored(whole, "split-nodes")
    names = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["depth", "conv_id", *figures, "ends_sha256", "parent_conv_id"]
    # A child finds its parent by block as well: no parent's children meet in one task.
    here = split.select("block", F.col("key").alias("parent_key")).join(names, "parent_key")
    closed = parts.filter("key is null")
    told = closed.filter("parent_key is not null").drop("parent_conv_id").join(here, ["block", "parent_key"])
    nodes = closed.filter("parent_key is null").select(*columns).unionByName(told.select(*columns))
    nodes = nodes.unionByName(whole.join(names, "parent_key", "left").select(*columns))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", *figures, F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")
    )


def conversation_trie(
    turns: DataFrame,
    cfg: Trie = Trie(),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns``; columns as in ``trie_nodes``."""
    own = stored(prepare(turn_cells(turns, conv_id, turn, role, text)), "conversations")
    rebuilt = stored(shared_heads(own), "rebuilt")
    return trie_nodes(distinct_paths(rebuilt, cfg), cfg)
