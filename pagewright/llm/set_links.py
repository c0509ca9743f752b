"""Links between texts that share a node, confirmed on whole shingle sets.

Used by both similarity joins. Nodes come from a candidate search; here every link among the
members of a node that connects something new is found, without a row per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .words import mix, shingle_sets, slices, texts_of, word_hashes

TILE_TEXTS = 1024
TILE_SHINGLES = 400_000
#: Texts and bytes of small groups that are compared at a time.
TILE_BATCH = 192
TILE_BATCH_BYTES = 1 << 20
COLUMNS = 4096
FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame, bit: Column | None = None) -> np.ndarray:
    """A fixed 8 MB filter: bit ``xxhash64(id) mod 2^26``, or the one given, is set for every id. Beyond
    some ten millions of ids it lets ever more others pass, which only costs work."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) if bit is None else bit
    words = ids.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def holds(wanted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bits are set in a filter."""
    bits = bits.astype(np.uint64)
    return (wanted[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1


def pack(texts: list[bytes]) -> list[bytes]:
    codec = pa.Codec("zstd", 3)
    return [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]


def _compress(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(holds(wanted, batch.column(2).to_numpy())))
            texts = texts_of(batch.column(1))
            words = [len(t.split()) for t in texts]
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(pack(texts), pa.binary())]
            yield pa.record_batch(columns, ["id", "shingles", "packed"])

    return run


def texts_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, compressed text and number of words (a bound for shingles) of the rows of
    ``docs`` (``id``, ``text``) whose id is in ``ids``. A filter of bounded size drops most
    other texts before they are shuffled."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")
    likely = docs.filter("id is not null").select("id", "text", bit)
    packed = likely.mapInArrow(_compress(id_filter(ids)), "id bigint, shingles bigint, packed binary")
    return packed.join(ids.select("id").distinct().hint("merge"), "id", "left_semi")


def unpack(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _compare(width: int, percent: int):
    """Rows sorted by head and salt, the head's own text first: a, b, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine = None, None
        for batch in slices(batches, 3, 1 << 20):
            texts = [unpack(x) for x in batch.column(3).to_pylist()]
            words, _, _, counts = word_hashes(texts)
            links = []
            rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(words, counts, width))
            for a, b, found in rows:
                if b is None:
                    head, mine = a, found
                elif head == a and len(found):
                    both = len(np.intersect1d(mine, found, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(found) - both):
                        links.append((a, b))
            yield pa.record_batch(
                [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"]
            )

    return run


def confirm_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int, salts: int) -> DataFrame:
    """The pairs whose whole shingle sets are similar. The members of a popular head are dealt
    to ``salts`` groups, each with a copy of the head's text."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "packed")
    heads = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a")
    heads = heads.select("a", "salt", F.lit(None).cast("bigint").alias("b"), "packed")
    rows = members.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_compare(width, percent), "a bigint, b bigint").distinct()


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """``node``, ``id``, ``head`` (the smallest id) of the nodes with two members or more. Of
    nodes with the same members, one stays."""
    # Dealt by node once, for the extremes and for the join with them.
    dealt = nodes.select("node", "id").repartition("node")
    ends = dealt.groupBy("node").agg(F.min("id").alias("head"), F.max("id").alias("last"))
    shared = stored(dealt.join(ends.filter("head != last").select("node", "head"), "node"), "colliding")
    members = shared.groupBy("node").agg(
        F.min("head").alias("head"), F.max("id").alias("last"), F.count("*").alias("size"),
        F.sum(F.xxhash64("id") % 1000000007).alias("one"), F.sum(F.xxhash64(F.lit(1), "id") % 1000000009).alias("two"),
    )
    kept = members.groupBy("head", "last", "size", "one", "two").agg(F.min("node").alias("node")).select("node")
    return stored(shared.join(kept, "node"), "shared-nodes")


def _links_of(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets are similar, exactly: intersections are counted on the values that
    two sets or more hold."""
    sizes = np.array([len(s) for s in sets], np.float64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes.astype(int))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], number[shared]
    column = np.cumsum(np.diff(number, prepend=-1) > 0) - 1 if len(number) else number
    both = np.zeros((len(sets), len(sets)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[owner[at], column[at] - first] = 1
        both += holds @ holds.T
    return (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))


def forest_of(link: np.ndarray) -> np.ndarray:
    """The smallest position that each position reaches."""
    n = len(link)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(link, label[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _tiles(width: int, percent: int):
    """Rows sorted by node and pair of tiles: node, i, j, id, packed. Returns a forest. Small groups,
    which are most, are compared some at a time: their shingles are told apart by a salt each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, packed = None, [], []
        held: list[tuple[list[int], list[bytes]]] = []
        links: list[tuple[int, int]] = []

        def compare() -> None:
            every = [one for group, _ in held for one in group]
            words, _, _, counts = word_hashes([unpack(x) for _, texts in held for x in texts])
            salts = np.repeat(mix(np.arange(len(held), dtype=np.uint64)), [len(group) for group, _ in held])
            root = forest_of(_links_of([s + salt for s, salt in zip(shingle_sets(words, counts, width), salts)], percent))
            links.extend((every[i], every[r]) for i, r in enumerate(root.tolist()) if i != r)
            held.clear()

        def finish() -> None:
            if len(ids) < 2:
                return
            each = [len(group) for group, _ in held]
            sizes = [int.from_bytes(x[:8], "little") for _, texts in [*held, (ids, packed)] for x in texts]
            if held and (sum(each) + len(ids) > TILE_BATCH or sum(sizes) > TILE_BATCH_BYTES):
                compare()
            held.append((ids, packed))

        def found() -> pa.RecordBatch:
            columns = list(zip(*links)) or [(), ()]
            links.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            for *now, one, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if now != key:
                    finish()
                    key, ids, packed = now, [], []
                ids.append(one)
                packed.append(text)
            yield found()
        finish()
        if held:
            compare()
        yield found()

    return run


def link_within_nodes(
    nodes: DataFrame,
    texts: DataFrame,
    likely: Callable[[DataFrame], DataFrame],
    width: int,
    percent: int,
    salts: int,
) -> DataFrame:
    """Components of all links among ids that share a node: ``id``, ``component``.

    ``nodes`` comes from ``distinct_nodes``, ``texts`` has ``id`` and ``packed``; ``likely``
    drops pairs that cannot be links. First every member is compared with the smallest id of
    its node, a comparison per member. Nodes whose members are then all connected are done. In
    the others, members are compared inside a task: a large node is cut into tiles of bounded
    size that meet pairwise. Members of the node's largest component lie in tiles of their own,
    which meet those of the other members only, so that a large group of copies with a few
    strangers isn't compared with itself.
    """
    texts = stored(texts, "texts")
    first = nodes.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    likely_pairs = stored(likely(first), "pairs")
    links = stored(confirm_pairs(likely_pairs, texts, width, percent, salts), "confirmed")
    label = components(links)
    marked = nodes.join(label, "id", "left").select("node", "id", F.coalesce("component", "id").alias("label"))
    marked = stored(marked, "labelled-nodes")
    parts = marked.groupBy("node", "label").agg(F.count("*").alias("members")).groupBy("node")
    torn = parts.agg(F.max_by("label", F.struct("members", "label")).alias("top"), F.count("*").alias("labels"))
    torn = torn.filter("labels > 1").select("node", "top")
    open_rows = marked.join(torn, "node").select("node", "id", (F.col("label") == F.col("top")).alias("inner"))
    open_rows = stored(open_rows.join(texts, "id").select("node", "id", "inner", "shingles", "packed"), "open-nodes")

    def tiles(side: Column) -> Column:
        members, shingles = F.count_if(side), F.sum(F.when(side, F.col("shingles")).otherwise(0))
        return F.ceil(F.greatest(members / TILE_TEXTS, shingles / TILE_SHINGLES)).cast("int")

    inner = F.col("inner")
    cut = open_rows.groupBy("node").agg(F.greatest(F.lit(1), tiles(inner)).alias("own"), F.greatest(F.lit(1), tiles(~inner)).alias("others"))
    number = F.pmod(F.xxhash64("id"), F.when(inner, F.col("own")).otherwise(F.col("others"))).cast("int")
    placed = open_rows.join(cut, "node").withColumn("tile", F.when(inner, number).otherwise(F.col("own") + number))
    end = F.col("own") + F.col("others") - 1
    # Two tiles that meet are also compared each with itself.
    partners = F.when(inner, F.sequence(F.col("own"), end)).otherwise(F.array_except(F.sequence(F.lit(0), end), F.array("tile")))
    met = placed.withColumn("other", F.explode(partners))
    met = met.select("node", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "id", "packed")
    rows = met.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    more = rows.mapInArrow(_tiles(width, percent), "a bigint, b bigint")
    return components(stored(links.unionByName(more), "links"))
