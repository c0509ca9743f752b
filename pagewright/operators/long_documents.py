"""Packing of documents too long for one row, word range by word range.

The units of a document are cut into folios of a fixed number of words, which may begin and end
inside a page, so that neither many pages nor one huge page make a large task. The only thing a
folio needs to know about everything before it is how many words it starts at and how many words
stand since the last flush, a number below the chunk size. Per folio we therefore compute the
table "words since flush on entry -> words since flush on exit"; tables compose, first
within spans of folios, then over spans, which gives every folio its true entry. After that
all folios find their flushes independently, and units and spans meet in a join on word
ranges. Folios hold numbers only; no task ever holds more than one span of tables or the units
of one page.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pagewright.config import EngineConfig
from pagewright.functions import text as tx
from pagewright.functions.ordered import running_totals
from pagewright.operators.chunking import flush_points
from pagewright.operators.units import unit_array
from pagewright.session import materialize

WORD_BUCKET = 4096
ASKED_AT_ONCE = 1024


def exit_table(ns, sections, start, target, overlap):
    """Exit state for each entry state.

    A state is the word of the last flush. Whatever flushes at a unit are the states up to a
    bound, which only grows, and they meet in one new state behind all others: a queue, in which
    every state is looked at once. The entry states are consecutive words, so those that have
    flushed are a range.
    """
    words = int(start)
    lowest = max(words - target + 1, 0)
    size = words - lowest + 1
    taken, ranges = 0, []
    made, into, live = [], [], deque()

    def flush(bound: int, at: int) -> None:
        nonlocal taken
        reached = min(bound - lowest + 1, size)
        if reached <= taken and not (live and made[live[0]] <= bound):
            return
        if not live or made[live[-1]] != at:
            made.append(at)
            into.append(-1)
            live.append(len(made) - 1)
        if reached > taken:
            ranges.append((taken, reached, live[-1]))
            taken = reached
        while made[live[0]] <= bound:
            into[live[0]] = live[-1]
            live.popleft()

    for n, section in zip(ns.tolist(), sections.tolist(), strict=True):
        # The buffer holds the words since the flush and, before it, up to ``overlap`` of the rest.
        over = words + n - target
        if section:
            flush(words - 1, words)
        elif over > 0:
            flush(min(words, over + overlap) - 1, words)
        words += n
        if over >= 0:
            flush(over + overlap, words)
    for node in range(len(made) - 1, -1, -1):
        if into[node] >= 0:
            made[node] = made[into[node]]
    last = np.arange(lowest, lowest + size)
    for low, high, node in ranges:
        last[low:high] = made[node]
    # No more words can stand since a flush than the document has had so far.
    return (words - last[np.maximum(size - 1 - np.arange(target), 0)]).astype(np.int32)


def flushes(ns, sections, start, since, target, overlap, last):
    """Word spans ``(b, e)`` flushed inside one folio, given its true entry state."""
    points, since, words = flush_points(ns.tolist(), sections.tolist(), int(start), int(since), target, overlap)
    out = [(b, e) for b, e, _ in points]
    return [*out, (words - since, words)] if last and since else out


def _ordered(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Groups side by side, each in order. A Python function then reads them as they stream by: no
    task holds a group, and a group costs no call of its own, of which short documents need many."""
    return df.repartition(*keys).sortWithinPartitions(*keys, position)


def _compose(target: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The exit table of each span from those of its folios, which come in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, table = None, None
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                if key != (r.document_id, r.span):
                    done += [] if key is None else [(*key, table)]
                    key, table = (r.document_id, r.span), np.arange(target, dtype=np.int32)
                table = np.asarray(r.exits, dtype=np.int32)[table]
            yield pd.DataFrame(done, columns=["document_id", "span", "exits"])
        if key is not None:
            yield pd.DataFrame([(*key, table)], columns=["document_id", "span", "exits"])

    return run


def _follow(
    group: list[str], number: str, first: str | None, state: str
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The state on entry to each row of a group, whose rows come in order: ``first`` names the
    column with that of its first row (none: 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, 0
        for pdf in batches:
            entries = []
            starts = pdf[first] if first else [0] * len(pdf)
            for found, start, exits in zip(zip(*[pdf[g] for g in group], strict=True), starts, pdf["exits"], strict=True):
                if key != found:
                    key, now = found, int(start)
                entries.append(now)
                now = int(exits[now])
            yield pdf[["document_id", number]].assign(**{state: entries})

    return run


@F.pandas_udf(ArrayType(LongType()))
def _ends(lengths: pd.Series) -> pd.Series:
    """Running totals of the lengths of each row's units."""
    return lengths.map(lambda ns: np.cumsum(ns, dtype=np.int64))


def _pages_with_units(pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row per page number, its units beside their lengths; equal numbers in order of text."""
    per_page = pages.groupBy("document_id", "page_number").agg(
        F.min("filename").alias("filename"),
        F.count("*").alias("copies"),
        F.array_sort(F.collect_list(F.struct("text"))).alias("texts"),
    )
    cut = per_page.select(
        "document_id",
        "page_number",
        "filename",
        "copies",
        F.flatten(
            F.transform("texts", lambda t: unit_array(tx.normalize_text(F.coalesce(t["text"], F.lit(""))), cfg.chunk_size))
        ).alias("units"),
    )
    measured = cut.withColumn("ns", F.col("units.n")).withColumn(
        "sections", F.transform("units.kind", lambda k: k == "section")
    )
    measured = materialize(measured.withColumn("ends", _ends("ns")), "long-pages")
    return measured.withColumn("words", F.coalesce(F.element_at(F.col("ends"), F.when(F.size("ends") > 0, -1)), F.lit(0)))


def _folios(pages: DataFrame, places: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Lengths and kinds of the units that begin in each range of ``folio_words`` words."""
    lengths = pages.select("document_id", "page_number", "ns", "sections", "ends").join(
        places, ["document_id", "page_number"]
    )
    unit = F.transform(
        "ns",
        lambda n, i: F.struct(
            (F.col("page_start") + F.get("ends", i) - n).alias("at"), n.alias("n"), F.get("sections", i).alias("section")
        ),
    )
    return (
        lengths.select("document_id", F.explode_outer(unit).alias("unit"))
        .filter(F.col("unit").isNotNull())
        .groupBy("document_id", F.floor(F.col("unit.at") / cfg.folio_words).cast("long").alias("folio"))
        .agg(F.min("unit.at").alias("start"), F.array_sort(F.collect_list("unit")).alias("units"))
        .select("document_id", "folio", "start", F.col("units.n").alias("ns"), F.col("units.section").alias("sections"))
    )


def _page_starts(pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Words before each page."""
    words = pages.select("document_id", "page_number", "words")
    starts = running_totals(words, ["document_id"], "page_number", {"words": "page_start"}, cfg.folios_per_span)
    return materialize(starts, "page-starts")


def pack_long_documents(pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    target, overlap, per_span = cfg.chunk_size, cfg.chunk_overlap, cfg.folios_per_span

    pages = _pages_with_units(pages, cfg)
    places = _page_starts(pages, cfg)
    lengths = materialize(_folios(pages, places, cfg), "folios")

    documents = pages.groupBy("document_id").agg(
        F.min("filename").alias("filename"), F.sum("copies").cast("int").alias("document_page_count")
    )
    last = lengths.groupBy("document_id").agg(F.max("folio").alias("last_folio"))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "document_id": pdf["document_id"],
                    "folio": pdf["folio"],
                    "exits": [
                        exit_table(r.ns, r.sections, r.start, target, overlap) for r in pdf.itertuples()
                    ],
                }
            )

    exits = materialize(
        lengths.mapInPandas(tables, "document_id string, folio long, exits array<int>").withColumn(
            "span", F.floor(F.col("folio") / per_span).cast("long")
        ),
        "folio-exits",
    )

    spans_of = _ordered(exits, ["document_id", "span"], "folio").mapInPandas(
        _compose(target), "document_id string, span long, exits array<int>"
    )
    by_span = _ordered(spans_of, ["document_id"], "span").mapInPandas(
        _follow(["document_id"], "span", None, "entry"), "document_id string, span long, entry int"
    )
    entries = _ordered(exits.join(by_span, ["document_id", "span"]), ["document_id", "span"], "folio").mapInPandas(
        _follow(["document_id", "span"], "folio", "entry", "since"), "document_id string, folio long, since int"
    )

    def find_flushes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                found = flushes(r.ns, r.sections, r.start, r.since, target, overlap, r.folio == r.last_folio)
                rows += [(r.document_id, r.folio, i, b, e) for i, (b, e) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["document_id", "folio", "place", "b", "e"])

    spans = materialize(
        lengths.join(entries, ["document_id", "folio"])
        .join(last, "document_id")
        .mapInPandas(find_flushes, "document_id string, folio long, place int, b long, e long"),
        "folio-spans",
    )
    counted = running_totals(
        spans.groupBy("document_id", "folio").agg(F.count("*").alias("found")),
        ["document_id"],
        "folio",
        {"found": "earlier"},
        per_span,
    ).drop("found")
    chunks = spans.join(counted, ["document_id", "folio"]).select(
        "document_id", (F.col("earlier") + F.col("place") + 1).cast("int").alias("sequence"), "b", "e"
    )
    return _assemble(pages, places, documents, chunks, cfg)


def _asked_of_pages(places: DataFrame, documents: DataFrame, chunks: DataFrame, overlap: int) -> DataFrame:
    """Per page, the chunks that hold words of it: numbers only, which meet by ranges of words."""

    def buckets(first: Column, behind: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / WORD_BUCKET).cast("long"), F.floor((behind - 1) / WORD_BUCKET).cast("long")))

    behind = F.col("page_start") + F.col("words")
    spans = places.filter("words > 0").withColumn("bucket", buckets(F.col("page_start"), behind))
    chunks = chunks.withColumn("since", F.greatest(F.col("b") - overlap, F.lit(0)))
    asking = chunks.withColumn("bucket", buckets(F.col("since"), F.col("e")))
    first = F.floor(F.greatest("page_start", "since") / WORD_BUCKET)  # a page and a chunk may share many
    met = spans.join(asking, ["document_id", "bucket"]).filter(
        (F.col("page_start") < F.col("e")) & (behind > F.col("since")) & (F.col("bucket") == first)
    )
    # A page with very many chunks meets some of them at a time.
    asked = met.groupBy("document_id", "page_number", F.floor(F.col("sequence") / ASKED_AT_ONCE).alias("block")).agg(
        F.first("page_start").alias("page_start"),
        F.first("words").alias("words"),
        F.collect_list(F.struct("sequence", "b", "e", "since")).alias("asked"),
    )
    return asked.drop("block").join(documents, "document_id")


@F.arrow_udf(ArrayType(StructType([StructField("first", IntegerType()), StructField("stop", IntegerType())])))
def _unit_ranges(ends: pa.Array, page_start: pa.Array, since: pa.Array, e: pa.Array) -> pa.Array:
    """Of the units of each page, which of them begin before the end of each chunk and end behind its start."""
    out = []
    for at, start, lows, highs in zip(ends, page_start.to_numpy(), since, e, strict=True):
        at = at.values.to_numpy() + start
        first = np.searchsorted(at, lows.values.to_numpy(), "right")
        stop = np.searchsorted(np.append(start, at[:-1]), highs.values.to_numpy(), "left")
        out.append([{"first": i, "stop": j} for i, j in zip(first.tolist(), stop.tolist(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())])))


def _assemble(pages: DataFrame, places: DataFrame, documents: DataFrame, chunks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Texts of the chunks. Pages meet the numbers of their chunks, and a chunk inside one page is
    put together there; only the units of those that reach over pages are shuffled once more."""
    overlap = cfg.chunk_overlap
    asked = _asked_of_pages(places, documents, chunks, overlap)
    texts = pages.select("document_id", "page_number", "units", "ends").join(asked, ["document_id", "page_number"])
    ranges = _unit_ranges("ends", "page_start", "asked.since", "asked.e")

    def unit(j: Column) -> Column:
        u = F.get("units", j)
        at = F.col("page_start") + F.get("ends", j) - u["n"]
        page = F.col("page_number").alias("page")
        return F.struct(at.alias("at"), u["kind"].alias("kind"), u["n"].alias("n"), page, u["text"].alias("text"))

    def piece(ask: Column, i: Column) -> Column:
        found = F.get("ranges", i)
        inside = (ask["since"] >= F.col("page_start")) & (ask["e"] <= F.col("page_start") + F.col("words"))
        return F.struct(
            ask["sequence"].alias("sequence"), ask["b"].alias("b"), ask["e"].alias("e"), inside.alias("inside"),
            F.transform(F.sequence(found["first"], found["stop"] - 1), unit).alias("units"),
        )

    told = ["document_id", "filename", "document_page_count"]
    pieces = texts.withColumn("ranges", ranges).select(*told, F.explode_outer(F.transform("asked", piece)).alias("piece"))
    pieces = pieces.select(*told, "piece.*")
    parts = pieces.filter("not inside").groupBy(*told, "sequence", "b", "e")
    over_pages = parts.agg(F.array_sort(F.flatten(F.collect_list("units"))).alias("units"))
    gathered = pieces.filter("inside").drop("inside").unionByName(over_pages)
    split = gathered.withColumn("own", F.filter("units", lambda u: u["at"] >= F.col("b"))).withColumn(
        "prior", F.filter("units", lambda u: u["at"] < F.col("b"))
    )
    overlapped = F.size("prior") > 0
    own_text = F.array_join(F.col("own.text"), " ")
    prior_text = F.substring_index(F.array_join(F.col("prior.text"), " "), " ", -overlap)
    return split.select(
        "document_id",
        "filename",
        "document_page_count",
        "sequence",
        F.when(overlapped, F.concat_ws(" ", prior_text, own_text)).otherwise(own_text).alias("text"),
        F.when(overlapped, F.element_at("prior.page", -1)).otherwise(F.col("own.page")[0]).alias("start_page"),
        F.element_at("own.page", -1).alias("end_page"),
        (F.col("e") - F.col("b") + F.least(F.col("b"), F.lit(overlap))).cast("int").alias("word_count"),
        F.array_distinct(
            F.when(overlapped, F.concat(F.array(F.lit("overlap")), F.col("own.kind"))).otherwise(
                F.col("own.kind")
            )
        ).alias("source_boundaries"),
    )
