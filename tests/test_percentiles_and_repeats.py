"""Exact percentiles by narrowing ranges; questions whose id comes twice."""

import random

import pytest

from pagewright.operators.knn import knn
from pagewright.operators.telemetry import exact_percentiles


def expected(values, share):
    values = sorted(v for v in values if v is not None)
    return next(v for i, v in enumerate(values, 1) if i >= share * len(values) - 1e-12)


@pytest.mark.parametrize(("bins", "few"), [(4, 3), (1024, 65_536)])
def test_exact_percentiles(spark, bins, few):
    rng = random.Random(bins)
    groups = {
        ("a", "hot"): [rng.choice([1.0, 2.0, 2.5]) for _ in range(400)] + [rng.uniform(0, 1e6) for _ in range(100)],
        ("a", "one"): [7.25],
        ("b", "wide"): [10.0 ** rng.uniform(-30, 30) for _ in range(200)] + [0.0, -5.0],
        ("b", "gaps"): [None, 3.0, 3.0, None, 9.0],
        ("c", "none"): [None],
    }
    rows = [(*k, v) for k, values in groups.items() for v in values]
    table = spark.createDataFrame(rows, "g string, h string, v double").repartition(3)
    found = {(r.g, r.h, r.share): r.found for r in exact_percentiles(table, ["g", "h"], "v", [0.01, 0.5, 0.95, 1.0], bins, few).collect()}
    want = {(*k, s): expected(v, s) for k, v in groups.items() if k != ("c", "none") for s in (0.01, 0.5, 0.95, 1.0)}
    assert found == want


def test_repeated_question_ids_keep_their_neighbours(spark):
    chunks = spark.createDataFrame(
        [(f"c{i}", "d", i, [1.0, i / 10]) for i in range(6)],
        "chunk_id string, document_fingerprint string, sequence int, embedding array<float>",
    )
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.5])], "question_id bigint, embedding array<float>")
    once = knn(twice.distinct(), chunks, 4).orderBy("question_id", "distance").collect()
    assert knn(twice, chunks, 4).orderBy("question_id", "distance").collect() == once
    assert [r.chunk_id for r in once if r.question_id == 1] == ["c0", "c1", "c2", "c3"]
