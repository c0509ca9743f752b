"""Removal of repeated substrings, exact to the byte, by suffix sorting around anchors.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one. Every such string contains an anchor: the least
hash of a short gram among its grams, which depends on the string alone. So equal strings have
equal anchors, and only anchors are shuffled, about one for 35 bytes:

1. Each anchor occurrence stands for the run of strings that chose it, its block. Equal blocks
   of a task, and then equal blocks of one gram, leave their earliest occurrence; the others
   are removed. A gram with one distinct block is settled.
2. Grams with several blocks (the edges of repeated passages) get their bytes. A task sorts the
   blocks' right contexts, and their left contexts reversed, by deep-shallow suffix sorting
   (``deep_shallow``). Two blocks share a string exactly if their contexts agree far enough to
   both sides, which the shared prefixes of the two orders tell; so for each of the block's
   strings the earliest occurrence is found by rank, without comparing pairs.
3. A gram with very many distinct blocks would be one large task: its strings are instead
   settled one by one, by a minimum that combines before the shuffle.
4. The removed ranges of a document meet its text.

Defined results: null and empty texts, and texts shorter than ``length``, lose nothing by
themselves. Rows without ``doc_id`` come after all others. Rows that repeat a document (same id
or none, same text) are the same document, and each gets its result; texts that differ under one
id or without any are documents of their own, in the order of a hash, and are told apart by 78
bits of hashes. An empty table gives an empty result. Other columns are ignored
by ``repeated_bytes`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, stored
from .deep_shallow import prefix_classes
from .words import mix, prefix_hashes, slices, texts_of

LAST = 2**63 - 1  # stands for a missing id
CHUNK = 1 << 20
SECOND = 0xC2B2AE3D27D4EB4F


@dataclass(frozen=True)
class Repeats:
    length: int = 100
    gram: int = 32
    large_group: int = 20_000
    task_rows: int = 20_000


# A place: position of the anchor (34 bits), strings of the block before the anchor (7) and in
# all less one (7), hash of the text (14), and whether its task has an earlier one (1).


def _pack(position, before, more, tag, copy):
    return ((((position << 7 | before) << 7 | more) << 14) | tag) << 1 | copy


def _unpack(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 29, (place >> 22) & 127, (place >> 15) & 127, (place >> 1) & 16383


def text_tag(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=2).digest(), "little") & 16383


def anchors(data: bytes, ends: np.ndarray, cfg: Repeats) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of all strings that lie within one text. ``ends``: where each text ends. Yields
    position, first string, last string, gram hash, block hash."""
    span = cfg.length - cfg.gram + 1  # grams of a string
    values = np.frombuffer(data, np.uint8)
    for first in range(0, max(0, len(data) - cfg.length + 1), CHUNK):
        part = values[first : first + CHUNK + cfg.length - 1]
        prefix, down = prefix_hashes(part)
        grams = mix((prefix[cfg.gram :] - prefix[: -cfg.gram]) * down[: -cfg.gram])
        # Least hash, and the rightmost of equal ones: both depend on the string alone.
        low = np.uint64((1 << 22) - 1)
        least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
        width = 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        starts = np.arange(len(least))
        at = (low - (least & low)).astype(np.int64)
        text = np.searchsorted(ends, first + starts, "right")
        inside = first + starts + cfg.length <= ends[np.minimum(text, len(ends) - 1)]
        starts, at, text = starts[inside], at[inside], text[inside]
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(starts)) - 1
        one, last, anchor = starts[head], starts[tail], at[head]
        stop = last + cfg.length
        second, second_down = prefix_hashes(part, SECOND)
        block = mix((second[stop] - second[one]) * second_down[one])
        shape = ((anchor - one) << 8 | (last - one)).astype(np.uint64)
        yield first + anchor, first + one, first + last, grams[anchor], mix(block ^ mix(shape))


def _anchor_rows(cfg: Repeats):
    """Rows route, block, doc, key, place: the earliest occurrence of each block in a run of texts to
    its gram, later ones spread evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            docs = np.array([LAST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            keys = batch.column(2).to_numpy()
            texts = texts_of(batch.column(1))
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            begins = ends - [len(t) for t in texts]
            tags = np.array([text_tag(t) for t in texts], np.int64)
            found = list(anchors(b"".join(texts), ends, cfg)) if len(texts) else []
            if not found:
                continue
            at, one, last, gram, block = (np.concatenate(x) for x in zip(*found))
            text = np.searchsorted(ends, at, "right")
            doc, key, place = docs[text], keys[text], _pack(at - begins[text], at - one, last - one, tags[text], 0)
            order = np.lexsort((place, key, doc, block, gram))
            gram, block, doc, key, place = gram[order], block[order], doc[order], key[order], place[order]
            copy = np.zeros(len(gram), bool)
            copy[1:] = (gram[1:] == gram[:-1]) & (block[1:] == block[:-1])
            # Equal rows are one occurrence; later ones follow the same head.
            head = np.maximum.accumulate(np.where(copy, 0, np.arange(len(gram))))
            same = (doc == doc[head]) & (key == key[head]) & (place == place[head])
            keep = ~copy | ~same
            copy = copy & ~same
            route = np.where(copy, mix(doc.astype(np.uint64) ^ mix(key.astype(np.uint64) ^ mix(place.astype(np.uint64)))), gram)
            columns = route.view(np.int64), block.view(np.int64), doc, key, place | copy
            yield pa.record_batch([pa.array(c[keep]) for c in columns], ["route", "block", "doc", "key", "place"])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route, block, doc, key, place. Returns doc, key, place and route of every occurrence
    to remove (route null), and of the first occurrence of each block of a gram that has
    several."""
    carried = None  # the last row's group: route, block, first doc, key and place, waiting row or None
    for batch in batches:
        route, block, doc, key, place = (batch.column(i).to_numpy() for i in range(5))
        copy = (place & 1).astype(bool)
        done = [(doc[copy], key[copy], place[copy], None)]
        route, block, doc, key, place = route[~copy], block[~copy], doc[~copy], key[~copy], place[~copy]
        n = len(route)
        if n:
            new_block = np.ones(n, bool)
            new_block[1:] = (route[1:] != route[:-1]) | (block[1:] != block[:-1])
            waiting = None
            if carried is not None and carried[0] == route[0]:
                waiting = carried[5]
                new_block[0] = carried[1] != block[0]
            head = np.maximum.accumulate(np.where(new_block, np.arange(n), -1))
            of_old = head < 0
            first_doc = np.where(of_old, carried[2] if carried else 0, doc[np.maximum(head, 0)])
            first_key = np.where(of_old, carried[3] if carried else 0, key[np.maximum(head, 0)])
            first_place = np.where(of_old, carried[4] if carried else 0, place[np.maximum(head, 0)])
            later = ~new_block & ((doc != first_doc) | (key != first_key) | (place != first_place))
            done.append((doc[later], key[later], place[later], None))
            # First occurrences, by route.
            at = np.flatnonzero(new_block)
            old = bool(carried is not None and carried[0] == route[0])
            routes = route[at]
            new_route = np.ones(len(at), bool)
            new_route[1:] = routes[1:] != routes[:-1]
            if len(at) and old and routes[0] == carried[0]:
                new_route[0] = False
            number = np.cumsum(new_route) - (0 if len(at) and not new_route[0] else 1)
            several = np.zeros(len(at), bool)
            if len(at):
                counts = np.bincount(number)
                if not new_route[0]:
                    counts[0] += 1  # with what was carried
                several = counts[number] > 1
                if not new_route[0] and waiting is not None:
                    done.append((*(np.array([x]) for x in waiting), np.array([route[0]])))
                    waiting = None
            done.append((doc[at[several]], key[at[several]], place[at[several]], routes[several]))
            last_route = route[-1]
            if len(at) and routes[-1] == last_route:
                pending = None if several[-1] else tuple(int(x[at[-1]]) for x in (doc, key, place))
            else:  # only more of the carried block
                pending = waiting
            carried = (last_route, block[-1], int(first_doc[-1]), int(first_key[-1]), int(first_place[-1]), pending)
        docs, keys, places = (np.concatenate([x[i] for x in done]) for i in range(3))
        routes = np.concatenate([np.zeros(len(x[0]), np.int64) if x[3] is None else x[3] for x in done])
        removed = np.concatenate([np.full(len(x[0]), x[3] is None) for x in done])
        yield pa.record_batch(
            [pa.array(docs), pa.array(keys), pa.array(places), pa.array(routes, mask=removed)],
            ["doc", "key", "place", "route"],
        )


def _pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 3)
    for batch in slices(batches, 1):
        texts = texts_of(batch.column(1))
        packed = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]
        doc = [LAST if x is None else x for x in batch.column(0).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array(doc, pa.int64()), batch.column(2), pa.array(packed, pa.binary())],
            ["id", "doc", "key", "packed"],
        )


def _unpack_text(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _blocks(cfg: Repeats):
    """Rows doc, key, packed text, list of (place, route): the blocks' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = _unpack_text(packed)
                tag = text_tag(text)
                for x in wanted:
                    position, before, more, its = (int(v) for v in _unpack(np.int64(x["place"])))
                    if its == tag:
                        first = position - before
                        rows.append((x["route"], doc, key, x["place"], text[first : first + more + cfg.length]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [*[pa.int64()] * 4, pa.binary()]
            names = ["route", "doc", "key", "place", "bytes"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _shared_strings(rows: list[tuple], cfg: Repeats) -> list[tuple[int, int, int, int, int]]:
    """Ranges (doc, key, tag, start, end) of strings that start earlier in another block of the same
    gram. ``rows``: route, doc, key, place, bytes."""
    route = np.array([r[0] for r in rows], np.int64)
    _, group = np.unique(route, return_inverse=True)
    doc = np.array([r[1] for r in rows], np.int64)
    key = np.array([r[2] for r in rows], np.int64)
    place = np.array([r[3] for r in rows], np.int64)
    position, before, more, tag = _unpack(place)
    wide = cfg.length - cfg.gram
    right = [r[4][b + cfg.gram :] for r, b in zip(rows, before.tolist())]
    left = [r[4][:b][::-1] for r, b in zip(rows, before.tolist())]
    right_place, right_common, _ = prefix_classes(right, group)
    left_place, left_common, _ = prefix_classes(left, group)
    # The gram itself may hide a collision of its hash.
    grams = {}
    gram = np.array([grams.setdefault(r[4][b : b + cfg.gram], len(grams)) for r, b in zip(rows, before.tolist())])
    rank = np.empty(len(rows), np.int64)
    by_start = np.lexsort((position, tag, key, doc))
    rank[by_start] = np.arange(len(rows))
    gone = np.zeros((len(rows), wide + 1), bool)
    for back in range(wide + 1):  # strings that start so far before the gram
        own = np.flatnonzero((back <= before) & (back >= before - more))
        if not len(own):
            continue
        agree_left = np.cumsum(left_common < back)[left_place[own]]
        agree_right = np.cumsum(right_common < wide - back)[right_place[own]]
        order = np.lexsort((rank[own], agree_right, agree_left, gram[own], group[own]))
        own, agree_left, agree_right = own[order], agree_left[order], agree_right[order]
        head = np.ones(len(own), bool)
        head[1:] = (
            (agree_left[1:] != agree_left[:-1])
            | (agree_right[1:] != agree_right[:-1])
            | (gram[own][1:] != gram[own][:-1])
            | (group[own][1:] != group[own][:-1])
        )
        earliest = own[np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))]
        later = reduce(np.logical_or, [x[own] != x[earliest] for x in (doc, key, tag, position)])
        gone[own[later], back] = True
    edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, near = np.nonzero(edges == 1)  # the nearest string to the gram of each run
    _, past = np.nonzero(edges == -1)
    start = position[row] - (past - 1)
    end = position[row] - near + cfg.length
    return list(zip(doc[row].tolist(), key[row].tolist(), tag[row].tolist(), start.tolist(), end.tolist()))


RANGE = "doc bigint, key bigint, tag int, start bigint, stop bigint"


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "key", "tag", "start", "stop"])


def _groups(cfg: Repeats):
    """Rows sorted by route: route, doc, key, place, bytes. Whole groups are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(5)))
            if len(rows) >= cfg.task_rows:
                whole = len(rows)
                while whole and rows[whole - 1][0] == rows[-1][0]:
                    whole -= 1
                if whole:
                    yield _ranges(_shared_strings(rows[:whole], cfg))
                    rows = rows[whole:]
        if rows:
            yield _ranges(_shared_strings(rows, cfg))

    return run


def _strings(cfg: Repeats):
    """Every string of the blocks: 128 bits of hash, doc, key, tag, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, place, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                position, before, more, tag = (int(v) for v in _unpack(np.int64(place)))
                for i in range(more + 1):
                    digest = hashlib.blake2b(data[i : i + cfg.length], digest_size=16).digest()
                    one, two = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
                    rows.append((one, two, doc, key, tag, position - before + i))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["one", "two", "doc", "key", "tag", "start"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def repeated_ranges(docs: DataFrame, cfg: Repeats) -> tuple[DataFrame, DataFrame]:
    """``docs``: id, text. Returns the removed ranges, which may overlap (doc, key, tag, start,
    stop), and the packed texts (id, doc, key, packed)."""
    docs = docs.select("id", "text", F.xxhash64("text").alias("key"))
    found = docs.mapInArrow(_anchor_rows(cfg), "route bigint, block bigint, doc bigint, key bigint, place bigint")
    dealt = found.repartition("route").sortWithinPartitions("route", "block", "doc", "key", "place")
    settled = stored(dealt.mapInArrow(_settle, "doc bigint, key bigint, place bigint, route bigint"), "settled-blocks")
    texts = docs.mapInArrow(_pack_text, "id bigint, doc bigint, key bigint, packed binary")
    first = F.shiftright("place", 29) - F.shiftright("place", 22).bitwiseAND(127)
    copies = settled.filter("route is null").select(
        "doc",
        "key",
        F.shiftright("place", 1).bitwiseAND(16383).cast("int").alias("tag"),
        first.alias("start"),
        (first + F.shiftright("place", 15).bitwiseAND(127) + cfg.length).alias("stop"),
    )
    edges = settled.filter("route is not null")
    wanted = edges.groupBy("doc", "key").agg(F.collect_list(F.struct("place", "route")).alias("wanted"))  # of one text
    blocks = texts.select("doc", "key", "packed").join(wanted, ["doc", "key"]).mapInArrow(
        _blocks(cfg), "route bigint, doc bigint, key bigint, place bigint, bytes binary"
    )
    blocks = stored(blocks, "edge-blocks")
    sizes = blocks.groupBy("route").count()
    large = sizes.filter(F.col("count") > cfg.large_group).select("route")
    small = blocks.join(large, "route", "left_anti")
    small = small.repartition("route").sortWithinPartitions("route")
    ranges = copies.unionByName(small.mapInArrow(_groups(cfg), RANGE))
    strings = blocks.join(large, "route", "left_semi").mapInArrow(
        _strings(cfg), "one bigint, two bigint, doc bigint, key bigint, tag int, start bigint"
    )
    earliest = strings.groupBy("one", "two").agg(F.min(F.struct("doc", "key", "tag", "start")).alias("head"))
    later = strings.join(earliest, ["one", "two"]).filter("struct(doc, key, tag, start) != head")
    ranges = ranges.unionByName(later.select("doc", "key", "tag", "start", (F.col("start") + cfg.length).alias("stop")))
    return stored(ranges, "removed-ranges"), texts


def _merged(text: bytes, ranges: list | None) -> np.ndarray:
    """Maximal removed runs of one text."""
    tag = text_tag(text) if ranges else 0
    own = sorted((x["start"], x["stop"]) for x in ranges or () if x["tag"] == tag)
    runs: list[list[int]] = []
    for start, stop in own:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    return np.array(runs, np.int64).reshape(-1, 2)


def _kept(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, packed, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = _unpack_text(packed)
            runs = _merged(text, ranges)
            kept = _kept(text, runs)
            rows.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _by_text(ranges: DataFrame) -> DataFrame:
    # As many as a text's own length allows, about one for 35 bytes; repeated rows repeat them.
    return ranges.groupBy("doc", "key").agg(F.collect_set(F.struct("tag", "start", "stop")).alias("ranges"))


def repeated_bytes(docs: DataFrame, cfg: Repeats = Repeats(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    rows = prepare(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")))
    ranges, texts = repeated_ranges(rows, cfg)
    met = texts.join(_by_text(ranges), ["doc", "key"], "left").select("id", "packed", "ranges")
    out = met.mapInArrow(_digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("doc_id", doc_id)


def _shorten(text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else x for x in batch.column(text_at).cast(pa.large_binary()).to_pylist()]
            ranges = batch.column(batch.num_columns - 1).to_pylist()
            # Bytes of a character that was cut through go with it.
            kept = [
                None if t is None else _kept(t, _merged(t, r)).decode("utf-8", "ignore") if r else t.decode()
                for t, r in zip(texts, ranges)
            ]
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(kept, batch.schema.types[text_at])
            if chars_at is not None:
                sizes = [len(k) if r else n for k, r, n in zip(kept, ranges, columns[chars_at].to_pylist())]
                columns[chars_at] = pa.array(sizes, batch.schema.types[chars_at])
            yield pa.record_batch(columns, batch.schema.names[:-1])

    return run


def without_repeats(docs: DataFrame, cfg: Repeats = Repeats()) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text`` (and ``n_chars`` set anew, if it has
    one); rows and other columns stay."""
    prepare(docs)
    ranges, _ = repeated_ranges(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text"), cfg)
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    # The row as a whole is one column, so that no name of its columns can clash.
    own = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc"), F.xxhash64("text").alias("key"))
    met = own.join(_by_text(ranges), ["doc", "key"], "left").select("row.*", F.col("ranges").alias(free_name(docs, "ranges")))
    at = docs.columns.index
    return met.mapInArrow(_shorten(at("text"), at("n_chars") if "n_chars" in docs.columns else None), docs.schema)
