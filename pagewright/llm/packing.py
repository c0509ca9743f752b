"""Mixture-controlled packing of token ids into fixed-length sequences.

Every source has a queue of its documents' ids. A window is a run of sequences; in each window
a deficit round-robin serves every queue its target share of the window's tokens, and what a
queue could not be served in whole tokens is carried on as its deficit. Served tokens up to any
window follow from the shares in closed form, so that windows need no sequential pass: a
document's place in its queue decides its windows, sequences and offsets. A queue that runs
out leaves its share to the others. The stream of windows has no gaps; only the last sequence
may be short.

Places in queues are carried across partitions by totals per partition and source: each task
counts its own tokens, a small table adds what earlier partitions hold, and no queue is
gathered or sorted. One source may hold any share of the rows. Up to ``max_queues`` sources
have their schedule in every task. Beyond that, the same schedule is a table: one row for each
source and window in which it is served, joined with the documents' pieces.

Defined results: a null text counts as empty, and an empty text is the end id alone. Null is a
source of its own. Repeated rows are packed repeatedly. A null ``doc_id`` stays null. An empty
table gives no piece. Other columns are ignored. Targets for sources without a document have no
effect.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored


@dataclass(frozen=True)
class Packing:
    """``window`` sequences are filled to the target shares together. ``targets`` maps sources
    to weights; without it the shares are those of the corpus, which hold to the end.
    ``specials`` are texts that are one id each, wherever they occur.
    ``max_queues`` only chooses between a schedule in memory and one in a table; the pieces are
    the same."""

    length: int = 1024
    window: int = 64
    end_id: int = 0
    max_queues: int = 256
    cached_words: int = 300_000
    targets: tuple[tuple[str | None, float], ...] | None = None
    specials: tuple[tuple[str, int], ...] = ()


def special_tokens(tokenizer_file: str) -> tuple[tuple[str, int], ...]:
    """The special tokens that a tokenizer's JSON file names."""
    with open(tokenizer_file, encoding="utf-8") as told:
        return tuple((t["content"], t["id"]) for t in json.load(told).get("added_tokens", ()))


#: White space directly before a space: there, cutting before the space could change ids.
_RUN = re.compile(r"[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


class Encoder:
    """Byte-level BPE ids. Words are cut before single spaces, where the vocabulary's pattern
    always cuts, and each distinct word is encoded once. ``specials`` are texts with an id of
    their own, as in the tokenizer's file."""

    def __init__(self, ranks_file: str, pattern: str, cached_words: int, specials: tuple[tuple[str, int], ...] = ()) -> None:
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        if max((i for _, i in specials), default=0) >= 1 << 16:
            self.kind = np.dtype("<u4")
        self.limit, self.words = cached_words, {}
        # The longest of those that begin at one place.
        marks = sorted((re.escape(t) for t, _ in specials), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(marks)})") if marks else None
        self.special_ids = {t: np.array([i], self.kind).tobytes() for t, i in specials}

    def ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if self.special is None or not any(t in text for t in self.special_ids):
            return self.encode_plain(text)
        parts = self.special.split(text)
        return b"".join(self.special_ids[t] if i % 2 else self.encode_plain(t) if t else b"" for i, t in enumerate(parts))

    def encode_plain(self, text: str) -> bytes:
        if _RUN.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        out = list(map(self.words.get, rest))
        if None in out:
            if len(self.words) > self.limit:
                self.words.clear()
            for i, found in enumerate(out):
                if found is None:
                    word = rest[i]
                    if (found := self.words.get(word)) is None:
                        found = self.ids(" " + word)
                        if len(word) < 64:
                            self.words[word] = found
                    out[i] = found
        return self.ids(first) + b"".join(out)


def _encoded(ranks_file: str, pattern: str, cfg: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(ranks_file, pattern, cfg.cached_words, cfg.specials), TaskContext.get().partitionId()
        end = np.array([cfg.end_id], encoder.kind).tobytes()
        slots: dict[str | None, int] = {}
        served: list[int] = []
        for batch in batches:
            sources = batch.column(1).to_pylist()
            ids = [encoder.encode(t or "") + end for t in batch.column(2).to_pylist()]
            sizes = [len(x) // encoder.kind.itemsize for x in ids]
            places, at = [], []
            for source, n in zip(sources, sizes):
                if (slot := slots.setdefault(source, len(served))) == len(served):
                    served.append(0)
                places.append(slot)
                at.append(served[slot])
                served[slot] += n
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sources, pa.string()),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(places, pa.int32()),
                    pa.array(at, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "source", "part", "slot", "at", "n", "ids"],
            )

    return run


class Schedule:
    """Tokens served to each queue before each window.

    In a phase, all queues with tokens left share every window by weight; a phase ends with
    the window in which a queue runs out. ``served`` falls short of the exact share by less
    than one token, the queue's deficit, which later windows make up.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int) -> None:
        self.totals, self.window, self.phases = totals, window, []
        base, first = [0] * len(totals), 0
        while any(b < t for b, t in zip(base, totals)):
            share = [w if b < t else 0 for w, b, t in zip(weights, base, totals)]
            if not any(share):  # only unwanted sources are left: by size
                share = [t - b for b, t in zip(base, totals)]
            whole = sum(share)
            windows = min(-(-(t - b) * whole // (window * w)) for w, b, t in zip(share, base, totals) if w)
            self.phases.append((first, base, share, whole))
            first += windows
            base = [self.served(q, first) for q in range(len(totals))]
        self.windows = first
        self.starts = [p[0] for p in self.phases]

    def served(self, queue: int, window: int) -> int:
        phase = self.phases[-1]
        if window < phase[0]:
            phase = self.phases[bisect_right(self.starts, window) - 1]
        first, base, share, whole = phase
        return min(self.totals[queue], base[queue] + self.window * (window - first) * share[queue] // whole)

    def pieces(self, queue: int, begin: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Where tokens [begin, begin + n) of a queue go: start among them, length, window and
        position in the stream."""
        at, end = begin, begin + n
        k = bisect_right(range(self.windows + 1), begin, key=lambda w: self.served(queue, w)) - 1
        while at < end:
            low, high = self.served(queue, k), self.served(queue, k + 1)
            if high > at:
                before = sum(self.served(q, k + (q < queue)) for q in range(len(self.totals)))
                stop = min(high, end)
                yield at - begin, stop - at, k, before + at - low
                at = stop
            k += 1


def _cut(schedule: Schedule, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            columns = (batch.column(i).to_pylist() for i in range(6))
            for doc, queue, begin, n, ids, source in zip(*columns):
                data = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                for start, size, window, place in schedule.pieces(queue, begin, n):
                    while size:
                        take = min(size, length - place % length)
                        crc = zlib.crc32(data[start : start + take].tobytes())
                        rows.append((doc, start, take, crc, n, place // length, place % length, source, window))
                        start, place, size = start + take, place + take, size - take
            columns = list(zip(*rows)) or [()] * len(PIECE)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, PIECE.values())], list(PIECE))

    return run


PIECE = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(), "offset": pa.int64(), "source": pa.string(), "window": pa.int64(),
}
PIECE_SCHEMA = ", ".join(f"`{k}` {'string' if v == pa.string() else 'bigint'}" for k, v in PIECE.items())


class Queues:
    """The schedule of any number of queues, each on its own. Sources with a target weight go
    by ``Schedule``, as if alone; then all others, by size, in one phase."""

    def __init__(self, wanted: Schedule, rest: int, window: int) -> None:
        self.wanted, self.rest, self.window = wanted, rest, window

    def served(self, queue: int | None, total: int, window: int) -> int:
        if queue is not None:
            return self.wanted.served(queue, window) if self.wanted.phases else 0
        return min(total, self.window * max(0, window - self.wanted.windows) * total // self.rest)

    def window_of(self, queue: int | None, total: int, token: int) -> int:
        """The window that serves a queue's token."""
        if queue is not None:
            windows = range(self.wanted.windows + 1)
            return bisect_right(windows, token, key=lambda w: self.wanted.served(queue, w)) - 1
        return self.wanted.windows - (-(token + 1) * self.rest // (self.window * total)) - 1

    def runs(self, queue: int | None, total: int, begin: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Where tokens [begin, begin + n) of a queue go: start among them, length, window and
        place among the queue's tokens of the window."""
        at, end = begin, begin + n
        while at < end:
            k = self.window_of(queue, total, at)
            low, stop = self.served(queue, total, k), min(end, self.served(queue, total, k + 1))
            yield at - begin, stop - at, k, at - low
            at = stop


ROWS = 10_000  # of a batch


def _cells(queues: Queues):
    """Rows source, total, window and tokens of every window that serves a queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["source", "total", "window", "tokens"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        for batch in batches:
            for source, total, queue in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for _, size, window, _ in queues.runs(queue, total, 0, total):
                    rows.append((source, total, window, size))
                    if len(rows) == ROWS:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _split(queues: Queues):
    """Rows doc_id, source, n, start, window, near and ids of the parts of documents that lie in
    one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "n", "start", "window", "near", "ids"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            columns = (batch.column(i).to_pylist() for i in range(7))
            for doc, source, n, begin, ids, total, queue in zip(*columns):
                width = len(ids) // n
                for start, size, window, near in queues.runs(queue, total, begin, n):
                    rows.append((doc, source, n, start, window, near, ids[start * width : (start + size) * width]))
                    if len(rows) == ROWS:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows = []
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def _cut_parts(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            columns = (batch.column(i).to_pylist() for i in range(7))
            for doc, source, n, start, window, place, ids in zip(*columns):
                data, at = np.frombuffer(ids, f"<u{width}").astype("<u4"), 0
                while at < len(data):
                    take = min(len(data) - at, length - place % length)
                    crc = zlib.crc32(data[at : at + take].tobytes())
                    rows.append((doc, start + at, take, crc, n, place // length, place % length, source, window))
                    at, place = at + take, place + take
            columns = list(zip(*rows)) or [()] * len(PIECE)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, PIECE.values())], list(PIECE))

    return run


def _pack_by_table(encoded: DataFrame, totals: DataFrame, sources: DataFrame, width: int, cfg: Packing) -> DataFrame:
    """The pieces for any number of ``sources`` (source, tokens)."""
    spark, size = encoded.sparkSession, cfg.length * cfg.window
    weights = {x: w for x, v in dict(cfg.targets or ()).items() if (w := round(1e9 * v)) > 0}
    named = spark.createDataFrame([(x,) for x in weights], "name string")
    # At most as many as there are targets.
    found = sources.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name"))).collect()
    found = sorted(found, key=lambda r: (-r["tokens"], r["source"] is not None, r["source"] or ""))
    wanted = Schedule([r["tokens"] for r in found], [weights[r["source"]] for r in found], size)
    everything = sources.agg(F.sum("tokens")).first()[0]
    queues = Queues(wanted, everything - sum(r["tokens"] for r in found), size)
    numbers = spark.createDataFrame([(r["source"], i) for i, r in enumerate(found)], "name string, queue int")
    queued = sources.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name")), "left")
    queued = stored(queued.select("source", F.col("tokens").alias("total"), "queue"), "queues")

    cells = queued.repartition("source").mapInArrow(_cells(queues), "source string, total bigint, window bigint, tokens bigint")
    cells = stored(cells, "served-windows")
    # A window has at most its tokens' number of queues; windows are added up in blocks of 4096.
    windows = cells.groupBy("window").agg(F.sum("tokens").alias("tokens")).withColumn("block", F.shiftright("window", 12))
    blocks = windows.groupBy("block").agg(F.sum("tokens").alias("tokens"))
    so_far = F.coalesce(F.sum("tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", so_far.alias("block_begin"))
    inside = Window.partitionBy("block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    windows = windows.join(blocks, "block").select(
        "window", (F.col("block_begin") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("window_begin")
    )
    inside = Window.partitionBy("window").orderBy(F.desc("total"), "source").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("near", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(windows, "window")
    cells = cells.select(F.col("source").alias("s"), F.col("window").alias("w"), (F.col("window_begin") + F.col("near")).alias("cell"))
    cells = stored(cells, "window-places")

    earlier = Window.partitionBy("source").orderBy("part", "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", "slot", "source", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    starts = starts.join(queued.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("source", "s")
    placed = encoded.join(starts, ["part", "slot"]).select(
        "doc_id", "source", "n", (F.col("before") + F.col("at")).alias("begin"), "ids", "total", "queue"
    )
    parts = placed.mapInArrow(
        _split(queues), "doc_id bigint, source string, n bigint, start bigint, window bigint, near bigint, ids binary"
    )
    met = parts.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("window") == F.col("w"))).select(
        "doc_id", "source", "n", "start", "window", (F.col("cell") + F.col("near")).alias("place"), "ids"
    )
    return met.mapInArrow(_cut_parts(cfg.length, width), PIECE_SCHEMA)


def pack_documents(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    cfg: Packing = Packing(),
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pieces of documents: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``source`` and ``window``. Every id, the end id included, lies
    in exactly one piece."""
    rows = prepare(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")))
    schema = "doc_id bigint, source string, part int, slot int, at bigint, n bigint, ids binary"
    encoded = stored(rows.mapInArrow(_encoded(ranks_file, pattern, cfg), schema), "ids")
    totals = stored(
        encoded.groupBy("part", "slot", "source").agg(F.max(F.col("at") + F.col("n")).alias("tokens")), "queue-totals"
    )
    sources = totals.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    largest = sources.orderBy(F.desc("tokens"), "source").limit(cfg.max_queues + 1).collect()
    if len(largest) > cfg.max_queues:
        one = encoded.select((F.length("ids") / F.col("n")).cast("int")).first()[0]
        return _pack_by_table(encoded, totals, stored(sources, "sources"), one, cfg)
    names, sizes = [r["source"] for r in largest], [r["tokens"] for r in largest]
    wanted = dict(cfg.targets or ())
    weights = sizes if cfg.targets is None else [round(1e9 * wanted.get(x, 0.0)) for x in names]
    schedule = Schedule(sizes, weights, cfg.length * cfg.window)
    numbered = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, queue int")
    queued = totals.join(F.broadcast(numbered), F.col("source").eqNullSafe(F.col("name")), "left")
    earlier = Window.partitionBy("queue").orderBy("part", "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = queued.select("part", "slot", "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    placed = encoded.join(starts, ["part", "slot"]).select(
        "doc_id", "queue", (F.col("before") + F.col("at")).alias("begin"), "n", "ids", "source"
    )
    return placed.mapInArrow(_cut(schedule, cfg.length), PIECE_SCHEMA)
