"""Greedy packing of units into overlapping chunks.

The packing looks sequential, but after every flush its state depends only on where the
flush happened: a flush after word ``b`` restarts the buffer with the last
``min(overlap, b)`` words of the document, whatever came before. So the fold needs to know
only the words since the last flush, a chunk is the span between two flushes plus its
overlap, and the texts are put together afterwards.

Documents of ordinary length are gathered into one row each, which costs one shuffle.
Longer ones, by pages or by characters, would make that row the bottleneck; ``long_documents``
packs them word range by word range with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions import text as tx
from pagewright.operators.units import unit_array
from pagewright.schemas import CHUNK_COLUMNS

_POSITIONS = ("sequence", "prior", "first", "end", "start_page", "end_page", "words")
SPANS = f"array<struct<{','.join(f'{name}:int' for name in _POSITIONS)},kinds:array<string>>>"


def flush_points(
    ns: Sequence[int], sections: Sequence[bool], words: int, since: int, target: int, overlap: int
) -> tuple[list[tuple[int, int, int]], int, int]:
    """The buffer is flushed before a section, before a unit that would make it longer than the
    target, and once it has reached the target. Returns word spans ``(b, e)`` with the number of
    units up to ``e``, the words since the last flush and the words in all."""
    out, b = [], words - since
    for i, (n, section) in enumerate(zip(ns, sections, strict=True)):
        if words > b and (section or words - b + min(b, overlap) + n > target):
            out.append((b, words, i))
            b = words
        words += n
        if words - b + min(b, overlap) >= target:
            out.append((b, words, i + 1))
            b = words
    return out, words - b, words


def _spans(ns: list[int], kinds: list[str], sizes: list[int], target: int, overlap: int) -> list[dict]:
    """Chunks of one document as positions of units and pages. ``prior`` is the first unit that the
    overlap needs; ``sizes`` are the units of each page."""
    points, since, words = flush_points(ns, [k == "section" for k in kinds], 0, 0, target, overlap)
    if since:
        points.append((words - since, words, len(ns)))
    page_of = [page for page, size in enumerate(sizes) for _ in range(size)]
    out, first = [], 0
    for b, e, end in points:
        prior, found = first, 0
        while prior and found < overlap:
            prior -= 1
            found += ns[prior]
        overlapped = prior < first
        own = dict.fromkeys(kinds[first:end])
        out.append(
            {
                "sequence": len(out) + 1,
                "prior": prior,
                "first": first,
                "end": end,
                "start_page": page_of[first - overlapped],
                "end_page": page_of[end - 1],
                "words": e - b + min(b, overlap),
                "kinds": ["overlap", *own] if overlapped else list(own),
            }
        )
        first = end
    return out


def _chunk_spans(target: int, overlap: int) -> Callable[..., Column]:
    """Numbers and kinds cross into Python, no texts; they are unpacked a document at a time."""
    fields = [*((name, pa.int32()) for name in _POSITIONS), ("kinds", pa.list_(pa.string()))]

    def unpacked(row: pa.ListScalar) -> list:
        return row.values.to_numpy(zero_copy_only=False).tolist()

    def spans(ns: pa.Array, kinds: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = zip(ns, kinds, sizes, strict=True)
        found = [_spans(unpacked(n), unpacked(k), unpacked(s), target, overlap) for n, k, s in rows]
        return pa.array(found, pa.list_(pa.struct(fields)))

    return F.arrow_udf(spans, SPANS)


def _between(values: Column, start: Column, end: Column) -> Column:
    """Elements ``start`` to ``end`` (exclusive). ``slice`` would copy the whole array first."""
    return F.when(
        end > start, F.transform(F.sequence(start, end - 1), lambda j: F.get(values, j))
    ).otherwise(F.array().cast("array<string>"))


def _chunk_bodies(overlap: int) -> Column:
    """Chunk structs of a document from the columns ``spans``, ``units`` and ``numbers``."""
    numbers = F.col("numbers")

    def body(texts: Column, span: Column) -> Column:
        own = F.array_join(_between(texts, span["first"], span["end"]), " ")
        before = F.array_join(_between(texts, span["prior"], span["first"]), " ")
        return F.struct(
            span["sequence"].alias("sequence"),
            F.when(
                span["prior"] < span["first"], F.concat_ws(" ", F.substring_index(before, " ", -overlap), own)
            )
            .otherwise(own)
            .alias("text"),
            F.get(numbers, span["start_page"]).alias("start_page"),
            F.get(numbers, span["end_page"]).alias("end_page"),
            span["words"].alias("word_count"),
            span["kinds"].alias("source_boundaries"),
        )

    # Bound once: the optimizer would gather the texts anew for every one that is looked at.
    return tx.let(F.col("units.text"), lambda texts: F.transform("spans", lambda span: body(texts, span)))


def _pack_gathered(pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Chunks of documents short enough to gather: one shuffle on the document.

    Raw texts are shuffled, which are smaller than units and leave the work of cutting them
    to the evenly hashed side.
    """
    gathered = pages.groupBy("document_id").agg(
        F.min("filename").alias("filename"),
        F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"),
    )
    cut = gathered.select(
        "document_id",
        "filename",
        F.col("pages.page_number").alias("numbers"),
        F.transform("pages", lambda p: unit_array(tx.normalize_text(p["text"]), cfg.chunk_size)).alias("cut"),
    )
    flat = cut.select(
        "document_id",
        "filename",
        "numbers",
        F.transform("cut", F.size).alias("sizes"),
        F.flatten("cut").alias("units"),
    )
    spans = _chunk_spans(cfg.chunk_size, cfg.chunk_overlap)
    packed = flat.select(
        "document_id",
        "filename",
        "numbers",
        "units",
        spans("units.n", "units.kind", "sizes").alias("spans"),
    )
    bodies = packed.select(
        "document_id",
        "filename",
        F.size("numbers").alias("document_page_count"),
        _chunk_bodies(cfg.chunk_overlap).alias("chunks"),
    )
    # A plain explode would make the optimizer infer a filter on the array's size and
    # compute the whole array a second time for it.
    return (
        bodies.select("document_id", "filename", "document_page_count", F.explode_outer("chunks").alias("c"))
        .filter(F.col("c").isNotNull())
        .select("document_id", "filename", "document_page_count", "c.*")
    )


def finish(chunks: DataFrame) -> DataFrame:
    """Add the chunk id and bring the columns into the order of the chunk table."""
    return (
        chunks.withColumn(
            "chunk_id",
            tx.chunk_id(
                F.col("document_id"), F.col("sequence"), F.col("start_page"), F.col("end_page"), F.col("text")
            ),
        )
        .withColumnRenamed("document_id", "document_fingerprint")
        .select(*CHUNK_COLUMNS)
    )


def long_document_ids(pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Documents with more pages or characters than one row should hold."""
    return (
        pages.groupBy("document_id")
        .agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("characters"))
        .filter((F.col("pages") > cfg.long_document_pages) | (F.col("characters") > cfg.long_document_characters))
        .select("document_id")
    )


def chunk_documents(pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Chunks of every document with a usable fingerprint, filename and some text.

    ``pages`` has ``document_id``, ``filename``, ``page_number`` and the extracted ``text``.
    A scan that adds up pages and characters first looks for overlong documents; where there are
    none, the plan has a single shuffle.
    """
    from pagewright.operators.long_documents import pack_long_documents

    usable = pages.filter(
        (F.coalesce("document_id", F.lit("")) != "") & ~tx.is_blank(F.coalesce("filename", F.lit("")))
    )
    long_ids = long_document_ids(usable, cfg)
    found = long_ids.limit(cfg.broadcast_documents + 1).count()
    if found == 0:
        return finish(_pack_gathered(usable, cfg))

    # A short list of long documents is broadcast; beyond that size the join is left to
    # the planner, whose skew handling splits the long documents' partitions.
    marked = F.broadcast(long_ids) if found <= cfg.broadcast_documents else long_ids
    short = usable.join(marked, "document_id", "left_anti")
    long = usable.join(marked, "document_id")
    short_chunks = _pack_gathered(short, cfg)
    long_chunks = pack_long_documents(long, cfg)
    return finish(short_chunks.unionByName(long_chunks))
