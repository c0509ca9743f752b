"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct word shingles, sketched by minwise tokens. Every tree starts
with all documents in one node; a node chooses a few of the sketch's coordinates by its own
hash, and each document goes to the children named by its tokens there. Two documents with
equal tokens at a chosen coordinate stay together, so similar pairs meet in some deep node of
some tree, and others part early. Since choices depend on the node alone, each document finds
its nodes by itself; one shuffle brings the members of a node together. Nodes that are still
large branch on. Members of a node are compared on whole sets; a node whose members are all connected
already is left alone.

Defined results: null or empty texts and texts without words have no shingles and link with
nothing. Rows without ``doc_id`` link with nothing, and have no component; they are kept.
Rows that repeat a ``doc_id`` get its component. An empty table gives an empty result. All
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .set_links import distinct_nodes, link_within_nodes, texts_by_id
from .words import BASE, minhash, minhash_parameters, mix, set_digest, shingle_sets, slices, texts_of, word_hashes

SIZE = 64  # minwise tokens of a sketch
SEED = 20
#: Share of equal tokens below which a pair isn't compared. At similarity 0.75 the share has a
#: deviation of 0.054, so that one in a million such pairs falls below.
SCREEN = 0.48


@dataclass(frozen=True)
class ChosenPath:
    """``trees``, ``depth`` and ``deepest`` set the recall. Over the spread of a sketch's equal
    tokens, a pair at the threshold is missed with 0.00006 if its nodes are small, and with 0.0003
    if they are large in every tree: nodes below ``depth`` choose two coordinates each, so that
    similar pairs hardly part there."""

    width: int = 5
    percent: int = 75
    trees: int = 14
    depth: int = 3
    large_node: int = 2048
    deepest: int = 6
    salts: int = 64


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = minhash_parameters(SIZE, SEED)
        for batch in slices(batches, 1):
            words, _, _, counts = word_hashes(texts_of(batch.column(1)))
            sets = shingle_sets(words, counts, width)
            digests = [set_digest(s) for s in sets]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([minhash(s, parameters).tobytes() for s in sets], pa.binary()),
                ],
                ["id", "n", "one", "two", "sketch"],
            )

    return run


def choose(nodes: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates that each node chooses: one, and another with ``chance``. Returns rows of
    ``nodes`` and coordinates."""
    order = mix(nodes[:, None] + np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(BASE))
    first = order.argmin(axis=1)
    more = np.flatnonzero(mix(nodes ^ np.uint64(0xA24BAED4963EE407)) < np.uint64(min(int(chance * 2**64), 2**64 - 1)))
    rest = order[more]
    rest[np.arange(len(more)), first[more]] = np.iinfo(np.uint64).max
    return np.concatenate([np.arange(len(nodes)), more]), np.concatenate([first, rest.argmin(axis=1)])


def branch(nodes: np.ndarray, tokens: np.ndarray, chance: float = 1 / 3) -> tuple[np.ndarray, np.ndarray]:
    """Children of ``nodes``, given each one's row of ``tokens``, and the parents' rows."""
    rows, at = choose(nodes, chance)
    token = tokens[rows, at].astype(np.uint64)
    return mix(mix(nodes[rows] + at.astype(np.uint64)) ^ (token * np.uint64(BASE))), rows


def _few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def _nodes(ids: pa.Array, rows: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    # Two paths may lead to one node only by equal hashes; repeated rows are harmless.
    return pa.record_batch([pa.array(nodes.view(np.int64)), ids.take(pa.array(rows))], ["node", "id"])


def _first_nodes(cfg: ChosenPath):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, cfg.trees + 1, dtype=np.uint64) * np.uint64(BASE))
        for batch in _few_rows(batches):
            tokens = _tokens(batch.column(1))
            rows, nodes = np.repeat(np.arange(len(tokens)), cfg.trees), np.tile(roots, len(tokens))
            for _ in range(cfg.depth):
                nodes, parents = branch(nodes, tokens[rows])
                rows = rows[parents]
            yield _nodes(batch.column(0), rows, nodes)

    return run


def _next_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few_rows(batches):
        nodes = batch.column(0).to_numpy().view(np.uint64)
        children, rows = branch(nodes, _tokens(batch.column(2)), chance=1)
        yield _nodes(batch.column(1), rows, children)


def path_nodes(sketches: DataFrame, cfg: ChosenPath) -> DataFrame:
    """``node``, ``id`` for every leaf that holds two documents or more."""
    start = sketches.select("id", "sketch").mapInArrow(_first_nodes(cfg), "node bigint, id bigint")
    level, leaves = stored(start, "nodes"), None
    for depth in range(cfg.depth, cfg.deepest + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        last = depth == cfg.deepest
        found = level.join(sizes if last else sizes.filter(F.col("size") <= cfg.large_node), "node").drop("size")
        # Written, since joins whose skew was split differently fail when their union is read as one.
        found = stored(found, "leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = sizes.filter(F.col("size") > cfg.large_node)
        if last or large.isEmpty():
            return leaves
        grown = level.join(large.select("node"), "node").join(sketches.select("id", "sketch"), "id")
        level = stored(grown.select("node", "id", "sketch").mapInArrow(_next_nodes, "node bigint, id bigint"), "nodes")
    return leaves


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = int(SCREEN * SIZE)
        for batch in batches:
            equal = (_tokens(batch.column(4)) == _tokens(batch.column(5))).sum(axis=1)
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            keep = pa.array((equal >= least) & fits)
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return run


def near_duplicates(
    docs: DataFrame, cfg: ChosenPath = ChosenPath(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that can be reached
    by links) and ``kept`` (that is the document itself)."""
    docs = prepare(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    schema = "id bigint, n bigint, one bigint, two bigint, sketch binary"
    all_rows = stored(docs.mapInArrow(_sketches(cfg.width), schema), "sketches")
    linked = all_rows.filter("n > 0 and id is not null")
    # Equal sets are one node of the join: the smallest id stands for them.
    same = stored(linked.groupBy("one", "two").agg(F.min("id").alias("rep")), "representatives")
    sketches = stored(
        linked.join(same.select(F.col("rep").alias("id"), "one", "two"), ["id", "one", "two"], "left_semi")
        .dropDuplicates(["id", "one", "two"])
        .select("id", "n", "sketch"),
        "representative-sketches",
    )
    nodes = distinct_nodes(path_nodes(sketches, cfg))

    def likely(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        b = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        return both.mapInArrow(_alike(cfg.percent), "a bigint, b bigint")

    found = link_within_nodes(nodes, texts_by_id(docs, nodes), likely, cfg.width, cfg.percent, cfg.salts)
    # One id may stand for several sets, if its rows differ: all of them are then one class.
    group = same.join(found, same["rep"] == found["id"], "left").select(
        "one", "two", F.coalesce("component", "rep").alias("component_id")
    )
    narrow = all_rows.select("id", "n", "one", "two")
    out = narrow.filter("n > 0 and id is not null").join(group, ["one", "two"]).select("id", "n", "component_id")
    alone = narrow.filter("not (n > 0 and id is not null)").select("id", "n", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.unionByName(alone).select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept")
    )


def first_of_each_group(docs: DataFrame, cfg: ChosenPath = ChosenPath(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns."""
    gone = near_duplicates(docs, cfg, doc_id, text).filter("not kept").select(F.col(doc_id).alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")
