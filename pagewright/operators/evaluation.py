"""Calibration of the threshold and quality of retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.session import materialize, ship_package

_BASE = 0x9E3779B97F4A7C15
_FILTER_BITS = 26
_CALL_BYTES = 1 << 20


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Acceptance and precision at every threshold.

    ``scored`` has ``distance`` and ``relevant``. Each pair is counted once, at the lowest
    threshold that accepts it; running sums over the thresholds do the rest.
    """
    spark = scored.sparkSession
    levels = sorted(set(thresholds))
    grid = spark.createDataFrame([(t,) for t in levels], "threshold double")
    # Null where no threshold accepts the pair.
    lowest = F.coalesce(*[F.when(F.col("distance") <= t, F.lit(t)) for t in levels])
    counted = scored.groupBy(lowest.alias("threshold")).agg(
        F.count("*").alias("n"), F.count_if("relevant").alias("hits")
    )
    totals = counted.agg(F.sum("n").alias("pairs"), F.sum("hits").alias("relevant_pairs")).withColumn(
        "_one", F.lit(1)
    )
    # One row per threshold.
    upward = Window.partitionBy("_one").orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(counted, "threshold", "left")
        .withColumn("_one", F.lit(1))
        .withColumn("accepted", F.sum(F.coalesce("n", F.lit(0))).over(upward))
        .withColumn("accepted_relevant", F.sum(F.coalesce("hits", F.lit(0))).over(upward))
        .join(F.broadcast(totals), "_one")
        .select(
            "threshold",
            "pairs",
            "accepted",
            "accepted_relevant",
            F.round(F.col("accepted") / F.col("pairs"), 6).alias("acceptance_rate"),
            F.round(F.try_divide("accepted_relevant", "accepted"), 6).alias("precision"),
            F.round(F.try_divide("accepted_relevant", "relevant_pairs"), 6).alias("recall"),
        )
    )


def retrieval_quality(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per scenario: questions, how many found an expected chunk, and precision at k.

    ``results`` has ``question_id, chunk_id, rank``; ``expected`` has ``question_id, scenario``
    and ``chunk_id``, null where the question has no answer in the corpus (retrieving nothing
    is then right).
    """
    questions = expected.select("question_id", "scenario").distinct()
    wanted = expected.filter(F.col("chunk_id").isNotNull()).select(
        "question_id", "chunk_id", F.lit(1).alias("_good")
    ).distinct()
    judged = (
        results.join(wanted, ["question_id", "chunk_id"], "left")
        .groupBy("question_id")
        .agg(F.count("*").alias("retrieved"), F.count("_good").alias("good"))
    )
    answerable = wanted.groupBy("question_id").agg(F.count("*").alias("wanted"))
    per_question = (
        questions.join(judged, "question_id", "left")
        .join(answerable, "question_id", "left")
        .select(
            "scenario",
            F.coalesce("retrieved", F.lit(0)).alias("retrieved"),
            F.coalesce("good", F.lit(0)).alias("good"),
            F.coalesce("wanted", F.lit(0)).alias("wanted"),
        )
    )
    hit = F.when(F.col("wanted") > 0, F.col("good") > 0).otherwise(F.col("retrieved") == 0)
    return per_question.groupBy("scenario").agg(
        F.count("*").alias("questions"),
        F.count_if(hit).alias("hits"),
        F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"),
        F.round(F.try_divide(F.sum("good"), F.sum("retrieved")), 6).alias("precision_at_k"),
    )


class _Words:
    """Words of texts that stand one space apart: which text, and the bytes they begin and end at in
    all texts together. Spans of bytes have hashes by running sums: equal spans, equal hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts)
        values = np.frombuffer(self.data, np.uint8)
        gap = np.ones(len(values) + 2, bool)
        gap[1:-1] = (values == 0x20) | (values == 0x0A)
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")
        self.stop = np.searchsorted(self.text, self.text, "right")  # behind the text's last word
        powers = np.full((2, len(values) + 1), 1, np.uint64)
        powers[:, 1:] = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        up, self._down = np.cumprod(powers, axis=1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])

    def keys(self, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``first`` up to, but not with, ``behind``."""
        s, e = self.start[first], self.end[behind - 1]
        x = (self._sums[e] - self._sums[s]) * self._down[s]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _in_calls(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut into rows whose texts, the last column, have a few megabytes at most, or one row."""
    for batch in batches:
        sizes = np.cumsum([0, *pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + _CALL_BYTES, "right")) - 1)
            part = batch.slice(first, last - first)
            yield part, part.column(part.num_columns - 1).cast(pa.large_binary()).to_pylist()
            first = last


def _with_keys(seed: int):
    """Rows passage, wanted to passage, wanted, words, width and key: the hash of the first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _in_calls(batches):
            at = _Words(texts)
            first = np.searchsorted(at.text, np.arange(len(texts)))
            words = at.stop[first] - first
            width = np.minimum(words, seed)
            columns = [pa.array(words, pa.int32()), pa.array(width, pa.int32()), pa.array(at.keys(first, first + width).view(np.int64))]
            yield pa.record_batch([*batch.columns, *columns], ["passage", "wanted", "words", "width", "key"])

    return run


def _bits(keys: DataFrame) -> np.ndarray:
    """A filter of 8 MB: the bit that the first bits of a key name is set. Any number of keys fits."""
    bit = F.shiftrightunsigned("key", 64 - _FILTER_BITS)
    words = keys.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros((1 << _FILTER_BITS) // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _windows(widths: list[int], longest: int, bits: np.ndarray):
    """Rows document, text to document, key and the words from there on, for the windows of words
    whose key passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _in_calls(batches):
            at = _Words(texts)
            for width in widths:
                first = np.flatnonzero(at.stop - np.arange(len(at.stop)) >= width)
                keys = at.keys(first, first + width)
                bit = keys >> np.uint64(64 - _FILTER_BITS)
                near = np.flatnonzero((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                first, keys = first[near], keys[near]
                ends = at.end[np.minimum(first + longest, at.stop[first]) - 1]
                said = [at.data[a:b] for a, b in zip(at.start[first].tolist(), ends.tolist())]
                documents = batch.column(0).take(pa.array(at.text[first]))
                columns = [documents, pa.array(keys.view(np.int64)), pa.array(said, pa.binary()).cast(pa.string())]
                yield pa.record_batch(columns, ["document_fingerprint", "key", "said"])

    return run


def passages_in(chunks: DataFrame, passages: DataFrame, seed: int = 8, broadcast_keys: int = 2_000_000) -> DataFrame:
    """Which documents hold which passages: distinct ``passage``, ``document_fingerprint``.

    ``chunks`` has ``chunk_id``, ``document_fingerprint`` and ``text``; ``passages`` has ``passage``. A passage
    is held where all its words stand in a chunk one after another. Windows of a chunk's words
    meet the first ``seed`` words of the passages by hash, shorter passages as a whole, and what
    meets is compared word by word. A filter of fixed size drops nearly all windows before they
    become rows; up to ``broadcast_keys`` hashes are broadcast and drop the rest before the shuffle.
    """
    ship_package(chunks.sparkSession)

    def spaced(text: Column) -> Column:
        return F.array_join(tx.words(text), " ")

    wanted = passages.distinct().select("passage", spaced(F.col("passage")).alias("wanted")).filter("wanted != ''")
    wanted = wanted.mapInArrow(_with_keys(seed), "passage string, wanted string, words int, width int, key long")
    wanted = materialize(wanted, "passages")
    told = wanted.groupBy("width").agg(F.max("words").alias("words")).collect()  # at most ``seed`` rows
    texts = chunks.select("document_fingerprint", spaced(F.col("text")).alias("text"))
    if not told:
        return texts.limit(0).select(F.lit("").alias("passage"), "document_fingerprint")
    keys = wanted.select("key").distinct()
    run = _windows(sorted(r.width for r in told), max(r.words for r in told), _bits(keys))
    found = texts.filter("text != ''").mapInArrow(run, "document_fingerprint string, key long, said string")
    if keys.count() <= broadcast_keys:
        found = found.join(F.broadcast(keys), "key", "left_semi")
    met = found.hint("merge").join(wanted.select("key", "passage", "wanted"), "key")
    met = met.filter(F.startswith(F.concat("said", F.lit(" ")), F.concat("wanted", F.lit(" "))))
    return met.select("passage", "document_fingerprint").distinct()
