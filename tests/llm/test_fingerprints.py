import hashlib
import os
import random

import numpy as np
import pytest

from pagewright.llm.fingerprints import Fingerprints, Sketches, fingerprint_versions, likeness, paragraph_digests

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, id int, place string, point string, bucket string, guest int"


def check(found, rows, cfg=Fingerprints()):
    """Edited texts by sorting all rows; likeness by the digests themselves."""
    order = sorted(((r[0] is None, -(r[0] or 0), r[1] or "") for r in rows))
    expected = {}
    for i, (none, doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own = []
        for t in (text, edited, after):
            own.append(set(paragraph_digests([t.encode()], cfg.words)[1].tolist()))
        near = [2 * len(own[0] & x) / (len(own[0]) + len(x)) if own[0] or x else 1.0 for x in own[1:]]
        key = (None if none else -doc, len(text), hashlib.sha256(edited.encode()).hexdigest())
        expected.setdefault(key, []).append(tuple(round(x, 9) for x in near))
    told = {}
    for r in found:
        told.setdefault((r.doc_id, r.n_chars, r.edited_sha256), []).append((round(r.near_edited, 9), round(r.near_next, 9)))
    assert {k: sorted(v) for k, v in told.items()} == {k: sorted(v) for k, v in expected.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cfg = Fingerprints(rows_per_range=17, cells=12)
    found = fingerprint_versions(docs, cfg).collect()
    check(found, rows, cfg)
    by_text = {}
    texts = dict(rows)
    for r in found:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_edge_cases(spark):
    rows = [(5, "é" * 10), (5, "é" * 10), (5, "other text"), (None, "no id"), (None, None), (-3, ""), (9, " \n "), (7, "x" * 300_000), (6, "a b\n" * 9)]
    docs = spark.createDataFrame([(*r, 1, "", "", "", 2) for r in rows], SCHEMA)
    for size in (1, 3, 2000):
        check(fingerprint_versions(docs, Fingerprints(rows_per_range=size)).collect(), rows)
    assert fingerprint_versions(spark.createDataFrame([], SCHEMA)).collect() == []
    check(fingerprint_versions(docs.filter("doc_id = 9")).collect(), [(9, " \n ")])


def test_peeling_recovers_differences_and_retries():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for d in (0, 1, 5, 200):
        a, b = (np.concatenate([shared, rng.integers(0, 2**63, d, dtype=np.uint64)]) for _ in range(2))
        table = Sketches(1, 24)
        table.add(np.zeros(len(a), np.int64), a)
        table.add(np.zeros(len(b), np.int64), b, -1)
        first, second, done = table.peel()
        if d <= 5:
            assert done[0] and first[0] == d and second[0] == d
        else:
            assert not done[0]
        text = np.repeat([0, 1], [len(a), len(b)])
        near = likeness(text, np.concatenate([a, b]), 2, np.array([0]), np.array([1]), 24)
        assert near[0] == pytest.approx(400 / (400 + d))


def test_an_edit_changes_the_paragraphs_around_it_only():
    words = [f"w{random.Random(i).randrange(1000)}" for i in range(400)]
    before = set(paragraph_digests([" ".join(words).encode()], 8)[1].tolist())
    words[200] = "edited"
    after = set(paragraph_digests([" ".join(words).encode()], 8)[1].tolist())
    assert len(before) > 20 and len(before ^ after) <= 5
