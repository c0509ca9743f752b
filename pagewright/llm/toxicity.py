"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are hashes of single words, pairs and triples of neighbours, and pairs with one word
between, each counted once per text. Training runs over a bounded, documented sample of
labelled documents in one task, with all features of each (kept in a local file, so that the
task's memory does not grow with the texts): every coordinate has its own learning rate, and L1
keeps most weights at exactly zero. The few others (at most ``max_weights``) go to the workers and score
every whole text; features are computed where the texts are, and only the sample's are moved.

Defined results: null and empty texts, and texts without known features, get the score of the
intercept. Null labels and labels without a document are ignored and take no part of the sample;
a document labelled repeatedly counts as toxic if any label says so. Without labels, or with one
class only, all scores are the smoothed share of toxic labels, and nothing is rejected. Rows
repeat as given. Other columns are ignored.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .words import mix, sequence_hashes, slices, texts_of, word_hashes


@dataclass(frozen=True)
class Toxicity:
    """``sample`` bounds the labelled documents that are learned from (smallest hashes of ids
    first); features of fewer than ``min_texts`` of them get no weight. ``threshold`` is the score from which a text is rejected."""

    bits: int = 20
    sample: int = 8192
    epochs: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    min_texts: int = 3
    max_weights: int = 200_000
    threshold: float = 0.3


def _features(words: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """Feature hashes by their first word, and how many words each kind spans."""
    pairs = sequence_hashes(words, 2) ^ np.uint64(0x1D8AF066)
    triples = sequence_hashes(words, 3) ^ np.uint64(0x2E0B4482)
    skips = mix(words[:-2] * np.uint64(0x9FB21C651E98DF25) + words[2:]) if len(words) > 2 else words[:0]
    shift = np.uint64(64 - bits)
    return [((mix(x) >> shift).astype(np.int64), span) for x, span in ((words, 1), (pairs, 2), (triples, 3), (skips, 3))]


def _by_text(words: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: text numbers and features, within texts only."""
    text = np.repeat(np.arange(len(counts)), counts)
    for found, span in _features(words, bits):
        mine, last = text[: len(found)], text[span - 1 :][: len(found)]
        inside = mine == last
        yield mine[inside], found[inside]


def _training_rows(cfg: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words, _, _, counts = word_hashes(texts_of(batch.column(2)))
            kinds = list(_by_text(words, counts, cfg.bits))
            text = np.concatenate([k[0] for k in kinds])
            found = np.concatenate([k[1] for k in kinds])
            both = np.unique((text << cfg.bits) | found)  # each feature once per text
            text, found = both >> cfg.bits, (both & ((1 << cfg.bits) - 1)).astype(np.int32)
            ends = np.searchsorted(text, np.arange(len(counts)), "right")
            parts = np.split(found, ends[:-1]) if len(counts) else []
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["order", "toxic", "features"],
            )

    return run


def _fit(cfg: Toxicity):
    """FTRL-proximal over all rows of the one task, ``epochs`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << cfg.bits
        texts = np.zeros(size, np.int32)
        told: list[tuple[int, int]] = []  # label and number of features, at most ``sample``
        with tempfile.TemporaryFile() as every, tempfile.TemporaryFile() as known:
            for batch in batches:
                for toxic, data in zip(batch.column(1), batch.column(2)):
                    found = np.frombuffer(data.as_buffer(), np.int32)
                    texts[found] += 1
                    every.write(found)
                    told.append((toxic.as_py(), len(found)))
            every.seek(0)
            for i, (toxic, count) in enumerate(told):
                found = _read(every, count)
                found = found[texts[found] >= cfg.min_texts]
                known.write(found)
                told[i] = toxic, len(found)
            yield _weights(told, known, cfg)

    return run


def _read(file: BinaryIO, count: int) -> np.ndarray:
    return np.frombuffer(file.read(4 * count), np.int32)


def _weights(told: list[tuple[int, int]], known: BinaryIO, cfg: Toxicity) -> pa.RecordBatch:
    """``told``: label and number of features of each text; ``known``: the features one after
    another."""
    size = 1 << cfg.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    weights = np.zeros(size + 1)
    positive = sum(t for t, _ in told)
    share = (positive + 1) / (len(told) + 2)
    weights[size] = np.log(share / (1 - share))
    if 0 < positive < len(told):
        z[size] = -weights[size] * (cfg.beta / cfg.alpha + cfg.l2)
        for _ in range(cfg.epochs):
            known.seek(0)
            for toxic, count in told:
                at = np.append(_read(known, count), size)
                w = weights[at]
                p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
                gradient = p - toxic
                grown = n[at] + gradient * gradient
                rate = (np.sqrt(grown) - np.sqrt(n[at])) / cfg.alpha
                z[at] += gradient - rate * w
                n[at] = grown
                steep = (cfg.beta + np.sqrt(grown)) / cfg.alpha + cfg.l2
                sparse = np.full(len(at), cfg.l1)
                sparse[-1] = 0.0
                pull = z[at]
                weights[at] = np.where(np.abs(pull) <= sparse, 0.0, -(pull - np.sign(pull) * sparse) / steep)
    kept = np.flatnonzero(weights[:size])
    kept = kept[np.argsort(-np.abs(weights[kept]), kind="stable")[: cfg.max_weights]]
    kept = np.append(np.sort(kept), size)
    return pa.record_batch([pa.array(kept, pa.int64()), pa.array(weights[kept])], ["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, cfg: Toxicity) -> tuple[np.ndarray, np.ndarray, float]:
    """``docs``: id, text; ``labels``: id, toxic. Returns features and weights, the intercept
    last, and the score from which to reject: beyond any unless both classes were seen."""
    told = labels.filter("id is not null and toxic is not null")
    told = told.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    told = told.join(docs.select("id"), "id", "left_semi")
    order = F.xxhash64("id")
    # Bounded by ``sample``; small enough to broadcast, so texts are not shuffled.
    chosen = stored(told.select("id", "toxic", order.alias("order")).orderBy("order").limit(cfg.sample), "sample")
    classes = chosen.agg(F.count_distinct("toxic")).first()[0]
    threshold = cfg.threshold if classes == 2 else math.inf
    texts = docs.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("order", "toxic", "text")
    schema = "order bigint, toxic int, features binary"
    rows = stored(texts.mapInArrow(_training_rows(cfg), schema), "training-rows")
    fitted = rows.repartition(1).sortWithinPartitions("order").mapInArrow(_fit(cfg), "feature bigint, weight double")
    found = fitted.collect()  # at most max_weights + 1
    if not found:  # nothing to learn from
        return np.array([1 << cfg.bits], np.int64), np.zeros(1), threshold
    return np.array([r.feature for r in found], np.int64), np.array([r.weight for r in found]), threshold


def _scores(features: np.ndarray, weights: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits)
        table[features[:-1]] = weights[:-1]
        for batch in slices(batches, 1):
            words, _, _, counts = word_hashes(texts_of(batch.column(1)))
            total = np.full(len(counts), weights[-1])
            for kind, (text, found) in enumerate(_by_text(words, counts, bits)):
                hit = table[found] != 0
                keys = (text[hit] << bits) | found[hit]
                each = keys if kind == 0 else np.concatenate([each, keys])
            each = np.unique(each)
            np.add.at(total, each >> bits, table[each & ((1 << bits) - 1)])
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch([batch.column(0), pa.array(score)], ["id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    cfg: Toxicity = Toxicity(),
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``. Labels of the
    held-out fold are not read."""
    rows = prepare(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    told = labels.select(F.col(doc_id).alias("id"), F.col(toxic).alias("toxic"))
    features, weights, _ = train(rows, told.filter(~held_out(F.col("id"))), cfg)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_scores(features, weights, cfg.bits), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(doc_id),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= cfg.threshold).cast("int").alias("predicted"),
    )


def _clean(features: np.ndarray, weights: np.ndarray, cfg: Toxicity, text: int):
    score = _scores(features, weights, cfg.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            place = pa.array(range(batch.num_rows), pa.int64())
            texts = pa.record_batch([place, batch.column(text)], ["id", "text"])
            for scored in score(iter([texts])):
                yield batch.filter(pa.array(scored.column(1).to_numpy() < cfg.threshold))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, cfg: Toxicity = Toxicity()) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    prepare(docs)
    told = labels.select(F.col("doc_id").alias("id"), "toxic").filter(~held_out(F.col("id")))
    features, weights, threshold = train(docs.select(F.col("doc_id").alias("id"), "text"), told, cfg)
    return docs.mapInArrow(_clean(features, weights, replace(cfg, threshold=threshold), docs.columns.index("text")), docs.schema)
