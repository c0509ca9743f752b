import math
import os

import numpy as np
import pytest

from pagewright.llm.pivot_index import PivotIndex, linked_vectors

from .brute import classes

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vector int, pivots string"


def links_of(rows, cosine=0.98):
    own = {}
    for vec, values, label, *_ in rows:
        if vec is not None and label is not None and values and None not in values:
            v = np.array(values, np.float32).astype(float)
            if np.isfinite(v).all() and v.any():
                own[vec] = (label, v / np.linalg.norm(v))
    found = set()
    items = list(own.items())
    for i, (a, (la, va)) in enumerate(items):
        for b, (lb, vb) in items[i + 1 :]:
            if la == lb and len(va) == len(vb) and va @ vb >= cosine:
                found.add((a, b))
    return found


def recall(found, links):
    """Links are exact up to those not retrieved: counts never exceed the true ones."""
    true = {}
    for a, b in links:
        true[a] = true.get(a, 0) + 1
        true[b] = true.get(b, 0) + 1
    assert all(r.n_links <= true.get(r.vec_id, 0) for r in found if r.vec_id is not None)
    return sum(r.n_links for r in found) / (2 * len(links)) if links else 1.0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_vectors_and_noisy_copies(spark):
    rng = np.random.default_rng(9)
    rows = [(r.vec_id, list(r.embedding), r.label, "", 1, "") for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    for vec, values, label, *_ in rows[::3]:
        for copy in (1, 2):
            noisy = np.array(values) + rng.standard_normal(len(values)) * 0.017 * copy
            rows.append((vec + 10_000 * copy, noisy.tolist(), label, "", 1, ""))
    links = links_of(rows)
    assert len(links) > 100
    assert recall(linked_vectors(spark.createDataFrame(rows, SCHEMA)).collect(), links) >= 0.9


def test_clusters_copies_and_tiles(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(12):
        centre = rng.standard_normal(24)
        for j in range(12):
            v = centre + rng.standard_normal(24) * rng.choice([0.0, 0.02, 0.1])
            rows.append((100 * i + j, (v * rng.choice([1.0, 3.0])).tolist(), i % 3, "", 1, ""))
    table = spark.createDataFrame(rows, SCHEMA)
    links = links_of(rows)
    up = classes([r[0] for r in rows], links)
    for cfg in (PivotIndex(), PivotIndex(tile=5)):
        found = linked_vectors(table, cfg).collect()
        assert recall(found, links) >= 0.9 and len(found) == len(rows)
        same = [r for r in found if r.component_id == up[r.vec_id]]
        assert len(same) >= 0.9 * len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_edge_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e-30, 0.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (12, [1.0, None], 1), (13, [-0.0, 1.0], 3), (14, [0.0, 1.0], 3)]
    found = linked_vectors(spark.createDataFrame([(*r, "", 1, "") for r in rows], SCHEMA), PivotIndex(shared=1)).collect()
    told = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in found)
    linked = {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False), 13: (1, 13, True), 14: (1, 13, False)}
    assert told == sorted((r[0] or -1, *linked.get(r[0], (0, r[0] or -1, True))) for r in rows)
    assert linked_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.001], 1), (3, [0.001, 1.0], 1), (4, [1.0, 0.002], 1), (1, [0.0, 1.0], 1)]
    found = linked_vectors(spark.createDataFrame([(*r, "", 1, "") for r in rows], SCHEMA), PivotIndex(shared=1)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]
