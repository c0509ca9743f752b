"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points, in order of nearness; the first few go
to inverted lists, one list per label, dimension and reference point. Vectors that meet in a
list and share enough reference points are candidates, and a pair counts in the first list it
shares, once. Candidates are verified by cosine in double precision on the vectors as given.

Equal vectors are one entry with a multiplicity. A list longer than a tile is cut into tiles
that meet pairwise, so that one label, cluster or reference point may hold any share of the
rows. Tasks return counts per vector and a spanning forest of the links they found, never
pairs. Reference points are drawn from a bounded sample of the table (``sample`` vectors with
the smallest hashes of their ids); every vector is indexed.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
rows without label or id, link with nothing. Vectors of different dimension don't link. Rows
that repeat an id with an equal vector are counted as one vector and get one result each; with
different vectors they are vectors of their own, which may link with each other. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, prepare, stored
from .set_links import forest_of
from .words import mix


@dataclass(frozen=True)
class PivotIndex:
    """``nearest`` of the reference points describe a vector, and ``shared`` of them must be
    common to a candidate pair. There is about one reference point for ``per_pivot`` vectors,
    within the bounds given, so that lists stay about equally long while a table grows.
    Reference points are less similar than ``apart``: close ones would split clusters."""

    cosine: float = 0.98
    nearest: int = 8
    shared: int = 2
    per_pivot: int = 256
    apart: float = 0.9
    least_pivots: int = 64
    most_pivots: int = 4096
    sample: int = 8192
    tile: int = 1024


def _arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's components in double precision, or null if it has no direction."""
    column = column.cast(pa.list_(pa.float64()))
    ends, values = column.offsets.to_numpy(), column.values
    numbers = values.to_numpy(zero_copy_only=False)  # null components become NaN
    for a, b, valid in zip(ends[:-1], ends[1:], column.is_valid().to_pylist()):
        row = numbers[a:b]
        yield row if valid and b > a and np.isfinite(row).all() and row.any() else None


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components would leave the range.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _digest(row: np.ndarray) -> tuple[int, int]:
    bits = (row + 0.0).view(np.uint64)
    place = np.arange(1, len(bits) + 1, dtype=np.uint64)
    return tuple(
        int(mix(bits * np.uint64(a) + mix(place * np.uint64(b))).sum(dtype=np.uint64).astype(np.int64))
        for a, b in ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0x94D049BB133111EB, 0xD6E8FEB86659FD93))
    )


def _described(pivots: dict[int, np.ndarray], nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)))
            for vec, label, row in rows:
                if row is None or vec is None or label is None:
                    out.append((vec, label, None, None, None, None, None))
                    continue
                near = _unit(row[None, :])[0] @ pivots[len(row)].T
                order = np.lexsort((np.arange(len(near)), -near))[:nearest]
                out.append((vec, label, len(row), *_digest(row), row.tobytes(), order.astype(np.int32).tolist()))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), batch.schema.types[1], pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
            names = ["id", "label", "dim", "one", "two", "vector", "pivots"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _tile(rows: list[tuple], pivot: int, across: bool, cfg: PivotIndex) -> tuple[list[tuple], list[tuple]]:
    """Counts and links of one list or of two tiles of it. ``rows``: tile, id, copies, vector,
    pivots."""
    ids = np.array([r[1] for r in rows])
    copies = np.array([r[2] for r in rows], np.int64)
    unit = _unit(np.stack([np.frombuffer(r[3], np.float64) for r in rows]))
    names, place = np.unique([r[4] for r in rows], return_inverse=True)
    member = np.zeros((len(rows), len(names)), np.float32)
    member[np.repeat(np.arange(len(rows)), len(rows[0][4])), place.ravel()] = 1
    earlier = member[:, names < pivot]
    candidate = (member @ member.T >= cfg.shared) & (earlier @ earlier.T == 0)
    if across:
        tile = np.array([r[0] for r in rows])
        candidate &= tile[:, None] != tile[None, :]
    np.fill_diagonal(candidate, False)
    link = candidate & (unit @ unit.T >= cfg.cosine)
    link |= link.T  # rounding may differ by side
    counts = link @ copies
    root = ids[forest_of(link)]
    hit = counts > 0
    return list(zip(ids[hit].tolist(), counts[hit].tolist())), [
        (int(a), int(b)) for a, b in zip(ids[hit], root[hit]) if a != b
    ]


def _lists(cfg: PivotIndex):
    """Rows sorted by list and pair of tiles: list key (four columns), pivot, i, j, tile, id,
    copies, vector, pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        counts: list[tuple] = []
        links: list[tuple] = []

        def finish() -> None:
            if len(rows) > 1:
                found = _tile(rows, key[2], key[3] != key[4], cfg)
                counts.extend(found[0])
                links.extend(found[1])

        def batch_of() -> pa.RecordBatch:
            both = [(a, n, None) for a, n in counts] + [(a, None, b) for a, b in links]
            columns = list(zip(*both)) or [()] * 3
            counts.clear()
            links.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["id", "n", "other"])

        for batch in batches:
            for label, dim, pivot, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in range(10))):
                if (label, dim, pivot, i, j) != key:
                    finish()
                    key, rows = (label, dim, pivot, i, j), []
                rows.append(tuple(rest))
            if len(counts) + len(links) > 50_000:
                yield batch_of()
        finish()
        yield batch_of()

    return run


def _apart(points: np.ndarray, wanted: int, most: float) -> np.ndarray:
    """The first ``wanted`` points that are not too similar to an earlier one."""
    kept: list[int] = []
    near = np.full(len(points), -1.0)
    for i in range(len(points)):
        if len(kept) == wanted:
            break
        if near[i] < most:
            kept.append(i)
            near = np.maximum(near, points @ points[i])
    return points[kept]


def reference_points(vectors: DataFrame, cfg: PivotIndex) -> dict[int, np.ndarray]:
    """Unit reference points per dimension, from the sample."""
    n = vectors.count()
    wanted = min(cfg.most_pivots, max(cfg.least_pivots, n // cfg.per_pivot))
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(min(cfg.sample, 2 * wanted)).collect()  # bounded by sample
    by_dim: dict[int, list[np.ndarray]] = {}
    for found in (r.embedding for r in rows):
        if found and all(x is not None and np.isfinite(x) for x in found) and any(found):
            by_dim.setdefault(len(found), []).append(np.array(found, np.float64))
    out = {}
    for (dim,) in vectors.select(F.size("embedding")).distinct().collect():  # one row per dimension
        if dim > 0:
            fill = np.random.default_rng(dim).standard_normal((cfg.least_pivots, dim))
            out[dim] = _apart(_unit(np.vstack([*by_dim.get(dim, []), fill])), wanted, cfg.apart)
    return out


def linked_vectors(
    vectors: DataFrame,
    cfg: PivotIndex = PivotIndex(),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    rows = prepare(
        vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    )
    pivots = reference_points(rows.select("id", "embedding").filter("embedding is not null"), cfg)
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"id bigint, label {kind}, dim int, one bigint, two bigint, vector binary, pivots array<int>"
    described = stored(rows.mapInArrow(_described(pivots, cfg.nearest), schema), "described")
    equal = ["label", "dim", "one", "two"]
    valid = described.filter("vector is not null")
    same = valid.groupBy(*equal).agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
    # An id may have several vectors: entries have numbers of their own, ascending with ``rep``.
    same = stored(same.orderBy("rep", *equal).withColumn("entry", F.monotonically_increasing_id()), "equal-vectors")
    entries = valid.join(same, equal).filter("id = rep").dropDuplicates(["entry"]).drop("id").withColumnRenamed("entry", "id")
    posted = stored(
        entries.select("id", "label", "dim", "copies", "vector", "pivots", F.explode("pivots").alias("pivot")), "postings"
    )
    sizes = posted.groupBy("label", "dim", "pivot").agg(F.count("*").alias("size")).filter("size > 1")
    tiled = posted.join(sizes, ["label", "dim", "pivot"]).withColumn("tiles", F.ceil(F.col("size") / cfg.tile).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = tiled.withColumn("other", other).select(
        "label", "dim", "pivot", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
        "tile", "id", "copies", "vector", "pivots",
    )
    lists = ["label", "dim", "pivot", "i", "j"]
    found = met.repartition(*lists).sortWithinPartitions(*lists).mapInArrow(_lists(cfg), "id bigint, n bigint, other bigint")
    found = stored(found, "vector-links")
    counts = found.filter("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = same.join(counts.withColumnRenamed("id", "entry"), "entry", "left")
    classes = classes.join(groups.withColumnRenamed("id", "entry"), "entry", "left").select(
        *equal,
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "entry").alias("head"),
    )
    heads = same.select(F.col("entry").alias("head"), F.col("rep").alias("component_id"))
    classes = classes.join(heads, "head").drop("head")
    out = valid.select("id", *equal).join(classes, equal).select("id", "n_links", "component_id")
    alone = described.filter("vector is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("id").alias(vec_id),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
