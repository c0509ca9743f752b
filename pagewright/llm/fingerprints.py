"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line breaks and behind words chosen by their own hash, so that
an edit changes the paragraphs around it only. Each paragraph's digest is added to three cells
of a small table: a count, a sum of digests, a sum of check values. The tables of two versions
subtract cell by cell; what both share vanishes, and peeling cells that hold a single digest
recovers the paragraphs in which they differ. If cells remain, both tables are built anew, four
times larger. The table of the first size is the stored fingerprint.

Each document is also compared with the next one in descending order of ``doc_id``. Documents
are sorted inside ranges of ids, and each range takes along the first document of the next one:
one shuffle of texts, and no task sees more than its range.

Defined results: null texts are empty. Two empty fingerprints have likeness 1. Rows without
``doc_id`` come last; rows that repeat a ``doc_id`` are ordered by text and each have a
successor. A single row is its own successor. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .words import mix, span_hashes, word_hashes

GROWTH, ATTEMPTS = 4, 9
_SALTS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


@dataclass(frozen=True)
class Fingerprints:
    """``cells`` of the stored sketch (a multiple of three); one word in ``words`` ends a
    paragraph."""

    cells: int = 24
    words: int = 8
    rows_per_range: int = 2000
    max_ranges: int = 20_000


def paragraph_digests(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and digest of every paragraph. The n-th copy of a paragraph in a text has a
    digest of its own."""
    data = b" ".join(texts)
    hashes, starts, ends, counts = word_hashes(texts)
    text_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    text_starts = text_ends - [len(t) + 1 for t in texts]
    line_ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    cuts = np.concatenate([ends[hashes % np.uint64(words) == 0], line_ends])
    edges = np.unique(np.concatenate([cuts, text_starts, text_ends]))
    first, last = edges[:-1], edges[1:]
    text = np.searchsorted(text_ends, first, "right")
    # The joining space, and white space alone, is no paragraph.
    last = np.minimum(last, text_ends[text] - 1)
    full = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    # A text of white space alone is one paragraph.
    bare = (counts[text] == 0) & (first == text_starts[text]) & (last > first)
    keep = full | bare
    text, digest = text[keep], span_hashes(data, first[keep], last[keep])
    order = np.lexsort((digest, text))
    text, digest = text[order], digest[order]
    same = np.zeros(len(text), bool)
    same[1:] = (text[1:] == text[:-1]) & (digest[1:] == digest[:-1])
    place = np.arange(len(text))
    copy = place - np.maximum.accumulate(np.where(same, 0, place))
    return text, mix(digest + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)


def _positions(keys: np.ndarray, table: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [table * cells + j * third + (mix(keys ^ s) % np.uint64(third)).astype(np.int64) for j, s in enumerate(_SALTS)]


class Sketches:
    """Tables of several texts side by side."""

    def __init__(self, tables: int, cells: int) -> None:
        self.tables, self.cells = tables, cells
        self.count = np.zeros(tables * cells, np.int64)
        self.key, self.check = (np.zeros(tables * cells, np.uint64) for _ in range(2))

    def add(self, table: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        wide = sign.astype(np.uint64)
        check = _check(keys)
        for at in _positions(keys, table, self.cells):
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, wide * keys)
            np.add.at(self.check, at, wide * check)

    def text(self, table: int) -> str:
        at = slice(table * self.cells, (table + 1) * self.cells)
        parts = self.count[at].astype("<i4"), self.key[at].astype("<u8"), self.check[at].astype("<u8")
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per table: digests on the first side alone, on the second alone, and whether all were
        recovered."""
        first, second = (np.zeros(self.tables, np.int64) for _ in range(2))
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            keys = self.key[look] * sign.astype(np.uint64)
            pure = (np.abs(sign) == 1) & (self.check[look] * sign.astype(np.uint64) == _check(keys))
            look, sign, keys = look[pure], sign[pure], keys[pure]
            table = look // self.cells
            # A digest may be alone in several of its cells.
            _, once = np.unique(keys ^ mix(table.astype(np.uint64)), return_index=True)
            table, keys, sign = table[once], keys[once], sign[once]
            if not len(keys):
                break
            self.add(table, keys, -sign)
            np.add.at(first, table[sign > 0], 1)
            np.add.at(second, table[sign < 0], 1)
            look = np.unique(np.concatenate(_positions(keys, table, self.cells)))
            look = look[np.abs(self.count[look]) == 1]
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return first, second, ~left.reshape(self.tables, self.cells).any(axis=1)


def likeness(
    text: np.ndarray, keys: np.ndarray, texts: int, left: np.ndarray, right: np.ndarray, cells: int
) -> np.ndarray:
    """Shared digests over the mean number of digests, for pairs of texts. Pairs that don't peel
    are tried again with larger tables."""
    sizes = np.bincount(text, minlength=texts)
    begin = np.searchsorted(text, np.arange(texts + 1))
    out = np.ones(len(left))
    todo = np.arange(len(left))
    for attempt in range(ATTEMPTS):
        if not len(todo):
            break
        tables = Sketches(len(todo), cells)
        for side, sign in ((left[todo], 1), (right[todo], -1)):
            n = sizes[side]
            rows = np.repeat(np.arange(len(todo)), n)
            at = np.repeat(begin[side], n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            tables.add(rows, keys[at], sign)
        mine, theirs, done = tables.peel()
        total = sizes[left[todo]] + sizes[right[todo]]
        value = 1 - (mine + theirs) / np.maximum(total, 1)
        out[todo[done]] = value[done]
        todo, cells = todo[~done], cells * GROWTH
    for i in todo:  # the digests themselves, should tables fail again and again
        a, b = (keys[begin[s[i]] : begin[s[i] + 1]] for s in (left, right))
        out[i] = 1 - len(np.setxor1d(a, b)) / max(1, len(a) + len(b))
    return out


def _results(rows: list[tuple], cfg: Fingerprints) -> pa.RecordBatch:
    """``rows``: id, text, next text."""
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for _, t, after in rows]
    n = len(rows)
    plain = [x.encode() for x in edited]
    texts = [t.encode() for _, t, _ in rows] + plain + [after.encode() for _, _, after in rows]
    text, keys = paragraph_digests(texts, cfg.words)
    stored = Sketches(2 * n, cfg.cells)
    mine = text < 2 * n
    stored.add(text[mine], keys[mine])
    own = np.arange(n)
    near = likeness(text, keys, 3 * n, np.tile(own, 2), np.concatenate([own + n, own + 2 * n]), cfg.cells)
    return pa.record_batch(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()),
            pa.array([stored.text(i) for i in range(n)], pa.string()),
            pa.array([stored.text(i) for i in range(n, 2 * n)], pa.string()),
            pa.array(near[:n]),
            pa.array(near[n:]),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _pairs(cfg: Fingerprints):
    """Sorted rows: range, guest, id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows, size = None, [], 0
        for batch in batches:
            for bucket, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if before is not None and before[0] == bucket:
                    rows.append((before[1], before[2], text))
                    size += len(before[2]) + len(text)
                if size > 2 << 20:
                    yield _results(rows, cfg)
                    rows, size = [], 0
                before = None if guest else (bucket, doc, text)
        if rows:
            yield _results(rows, cfg)

    return run


def fingerprint_versions(
    docs: DataFrame, cfg: Fingerprints = Fingerprints(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. The edited text has its last third
    replaced by the beginning of the next document."""
    spark = prepare(docs).sparkSession
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    place = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(2**63)))
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("id"),
        place.alias("place"),
        place.cast("double").alias("point"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    ranges = max(1, min(cfg.max_ranges, n // cfg.rows_per_range))
    cuts = rows.approxQuantile("point", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(edges) == 2:
        edges.insert(1, -1e300)
    ranged = Bucketizer(splits=edges, inputCol="point", outputCol="bucket").transform(rows)
    ranged = ranged.withColumn("bucket", F.col("bucket").cast("int"))
    # At most max_ranges rows.
    tops = sorted((r.bucket, r.top) for r in ranged.groupBy("bucket").agg(F.max("place").alias("top")).collect())
    hosts = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    wanted = F.broadcast(spark.createDataFrame(hosts, "place bigint, host int"))
    guests = rows.join(wanted, "place").groupBy("place", "host").agg(F.min("text").alias("text"))
    both = ranged.select("bucket", F.lit(False).alias("guest"), "id", "text", "place").unionByName(
        guests.select(
            F.col("host").alias("bucket"), F.lit(True).alias("guest"), F.lit(None).cast("bigint").alias("id"), "text", "place"
        )
    )
    tasks = min(len(edges) - 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = both.repartition(max(1, tasks), "bucket").sortWithinPartitions("bucket", "guest", F.desc("place"), "text")
    return ordered.select("bucket", "guest", "id", "text").mapInArrow(_pairs(cfg), schema)
