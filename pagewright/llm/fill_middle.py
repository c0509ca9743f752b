"""Fill-in-middle: texts are cut at two line ends and put together again around the middle.

Line ends are found by word arithmetic. The UTF-8 bytes of a run of texts are viewed as 64-bit
words; every byte that ends a line is marked in its word without a branch, marks are counted per
word, and a cut is found by a binary search over the summed counts and a selection inside one
word. The same marks of continuation bytes count code points. No text is split into lines.

Defined results: null texts are empty; empty texts, texts that hold a sentinel and texts beyond
``percent`` stay as they are (``plain``). A missing id counts as an empty one, and rows that
repeat an id are cut by the same numbers. The last line may lack its line break. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .words import slices

SENTINELS = ("<P>", "<S>", "<M>")

_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
_ONE = np.uint64(1)


@dataclass(frozen=True)
class FillMiddle:
    """``percent`` of the documents are transformed, and ``spm`` percent of those with the
    suffix first."""

    seed: int = 7
    percent: int = 100
    spm: int = 50


def newline_marks(words: np.ndarray) -> np.ndarray:
    """0x80 in every byte that is a line break."""
    x = words ^ _NEWLINES
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def continuation_marks(words: np.ndarray) -> np.ndarray:
    """0x80 in every byte that continues a code point (binary 10......)."""
    return words & ~(words << _ONE) & _HIGH


class Marks:
    """Ranks and selection over marked bytes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = np.append(marks, np.uint64(0))
        self.before = np.zeros(len(self.marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marks before byte ``at``."""
        word = at >> 3
        below = (_ONE << ((at & 7) * 8).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of mark number ``k`` (from 0), which must exist."""
        word = np.searchsorted(self.before[1:], k, "right")
        left, m = k - self.before[word], self.marks[word]
        for step in range(7):  # a word holds eight marks at most
            m = np.where(left > step, m & (m - _ONE), m)
        lowest = m & (~m + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3).astype(np.int64)


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts, filled up to whole words, and its offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0])
    padded = np.zeros((size + 7) // 8 * 8, np.uint8)
    if size:
        padded[:size] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return padded, offsets - offsets[0]


def cuts_of(column: pa.Array, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: number of lines, and of its start, the ends of prefix and middle, and its end
    the byte in the joined texts and the code points before it. ``one`` and ``two`` are the
    numbers that choose the cuts."""
    data, offsets = _words_of(column)
    words = data.view("<u8")
    lines, inside = Marks(newline_marks(words)), Marks(continuation_marks(words))
    start, end = offsets[:-1], offsets[1:]
    first = lines.rank(start)
    breaks = lines.rank(end) - first
    full = end > start
    bare = full.copy()
    bare[full] = data[end[full] - 1] != 10
    n = breaks + bare
    low, high = (f(one % (n + 1), two % (n + 1)) for f in (np.minimum, np.maximum))

    def byte_of(unit: np.ndarray) -> np.ndarray:
        at = np.where(unit > 0, end, start)
        by_mark = (unit > 0) & (unit <= breaks)
        at[by_mark] = lines.select((first + unit - 1)[by_mark]) + 1
        return at

    edges = [start, byte_of(low), byte_of(high), end]
    return n, edges, [e - inside.rank(e) for e in edges], data


def _transform(cfg: FillMiddle):
    """Rows id, text, h1 to h4 to id, n, form, prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 22):
            text = pc.fill_null(batch.column(1), "")
            h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(2, 6))
            n, edges, chars, data = cuts_of(text, h1, h2)
            plain = (n == 0) | (h3 % 100 >= cfg.percent)
            for mark in SENTINELS:
                plain |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
            spm = h4 % 100 < cfg.spm
            joined = data.tobytes()
            p, s, m = (x.encode() for x in SENTINELS)
            outputs = []
            for is_plain, is_spm, a, b, c, d in zip(plain.tolist(), spm.tolist(), *(e.tolist() for e in edges)):
                if is_plain:
                    outputs.append(joined[a:d])
                elif is_spm:
                    outputs.append(b"".join((s, joined[c:d], p, joined[a:b], m, joined[b:c])))
                else:
                    outputs.append(b"".join((p, joined[a:b], s, joined[c:d], m, joined[b:c])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(form.tolist(), pa.string()),
                    pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
                    pa.array(chars[2] - chars[1], pa.int64(), mask=plain),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(
    docs: DataFrame, cfg: FillMiddle = FillMiddle(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``n`` (lines), ``form`` (``plain``, ``psm`` or ``spm``),
    ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output``."""
    told = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("told", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), told.alias("told"))
    rows = prepare(rows.select("id", "text", *numbers))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(_transform(cfg), schema).withColumnRenamed("id", doc_id)


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
