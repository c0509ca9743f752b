import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions import vectors as vx
from pagewright.operators import embedding
from pagewright.operators.embedding import (
    Embedder,
    embed,
    embed_each,
    embedding_errors,
    hash_embed_texts,
    hash_embedder,
    mixed_models,
    missing_vectors,
    validate_vectors,
)
from pagewright.operators.knn import (
    _Asked,
    _by_broadcast,
    _exact,
    _matrix,
    _nearest,
    _Piece,
    _places,
    _sent_once,
    accept,
    knn,
    rank_candidates,
)

Q = "question_id long, embedding array<float>"
C = "chunk_id string, document_fingerprint string, sequence int, embedding array<float>"


def brute(questions, chunks, k, metric):
    out = {}
    for qid, q in questions:
        scored = []
        for cid, doc, seq, c in chunks:
            d = na = nb = l2 = 0.0
            for x, y in zip(q, c, strict=True):
                d += x * y
                na += x * x
                nb += y * y
                l2 += (x - y) * (x - y)
            scale = math.sqrt(na) * math.sqrt(nb)
            dist = {"l2": l2, "ip": 1.0 - d, "cosine": 1.0 if scale == 0 else 1.0 - d / scale}[metric]
            scored.append((dist, doc, seq, cid))
        out[qid] = sorted(scored)[:k]
    return out


def data(seed, n_questions, n_chunks, dim=8):
    rng = random.Random(seed)

    def vec():
        # A small value set makes many exact ties; a third of the chunks are one vector.
        return [float(np.float32(rng.choice([0, 0, 1, 2, -1]) * 0.1)) for _ in range(dim)]

    hot = vec()
    questions = [(i, vec()) for i in range(n_questions)]
    chunks = [
        (f"c{i:04d}", f"d{rng.randint(0, 9)}", rng.randint(1, 50), hot if i % 3 == 0 else vec())
        for i in range(n_chunks)
    ]
    return questions, chunks


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("passes", [False, True])
def test_knn_is_exact(spark, metric, passes):
    questions, chunks = data(5, 23, 300)
    cfg = EngineConfig(broadcast_questions=8) if passes else EngineConfig()
    got = knn(
        spark.createDataFrame(questions, Q), spark.createDataFrame(chunks, C).repartition(7), 6, metric, cfg
    ).collect()
    found = {}
    for r in got:
        found.setdefault(r.question_id, []).append((r.distance, r.document_fingerprint, r.sequence, r.chunk_id))
    assert {q: sorted(v) for q, v in found.items()} == brute(questions, chunks, 6, metric)


def test_passes_move_no_vectors(spark):
    questions, chunks = data(6, 40, 200)
    asked, corpus = spark.createDataFrame(questions, Q), spark.createDataFrame(chunks, C)
    hits, shared = _by_broadcast(asked, corpus, 4, "cosine", False)
    plan = _nearest(hits, 4)._jdf.queryExecution().executedPlan().toString()
    dealt = plan[: plan.index("MapInArrow")]
    assert plan.count("Exchange") == 1 and "Exchange" in dealt and "embedding" not in dealt
    shared.destroy()


def test_vectors_of_other_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        _matrix(pa.array([[1.0, 2.0], [1.0], [1.0, 2.0, 3.0]], pa.list_(pa.float32())))
    with pytest.raises(ValueError):
        _matrix(pa.array([[1.0, 2.0], None], pa.list_(pa.float32())))
    sliced = pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32())).slice(1)
    assert _matrix(sliced).tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_store_example(spark):
    chunks = spark.createDataFrame(
        [("a", "d1", 1, [1.0, 0.0]), ("b", "d1", 2, [0.0, 1.0]), ("c", "d2", 1, [1.0, 1.0])], C
    )
    question = spark.createDataFrame([(1, [1.0, 0.0])], Q)
    rows = rank_candidates(knn(question, chunks, 2)).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["a", "c"]
    assert abs(rows[0].distance) < 1e-9
    assert rows[0].source_id == "d1:a"
    assert accept(rank_candidates(knn(question, chunks, 9)), 1.0).count() == 3


def test_non_finite_distance_is_an_error(spark):
    chunks = spark.createDataFrame([("a", "d1", 1, [float("nan"), 0.0])], C)
    question = spark.createDataFrame([(1, [1.0, 0.0])], Q)
    with pytest.raises(Exception, match="INVALID_RETRIEVAL_DISTANCE"):
        knn(question, chunks, 2).collect()


def test_hash_embedding_agrees_with_native_buckets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    embedded = embed(docs, "text", hash_embedder())
    tokens = docs.select(
        "doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("token")
    ).filter("token != ''")
    counts = {}
    for r in tokens.groupBy("doc_id", vx.hash_bucket(F.col("token")).alias("b")).count().collect():
        counts.setdefault(r.doc_id, [0] * 128)[r.b] = r["count"]
    for r in embedded.collect():
        c = np.array(counts.get(r.doc_id, [0] * 128), dtype=float)
        expected = (c / np.sqrt((c * c).sum())).astype(np.float32) if c.any() else c
        assert np.array_equal(np.array(r.embedding, dtype=np.float32), expected)


def test_hash_embedding_keeps_no_tokens():
    texts = [" ".join(f"t{i}x{j}" for j in range(2000)) for i in range(200)]
    tracemalloc.start()
    hash_embed_texts(texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1_000_000 and peak < 12_000_000


@pytest.mark.parametrize("block", [1, 4, embedding.HASH_BLOCK])
def test_hash_embedding_in_blocks(monkeypatch, block):
    monkeypatch.setattr(embedding, "HASH_BLOCK", block)
    long = 2 * block
    texts = ["", "a", "", "ab  z9-ab", "é1ü a😀b", " \n", "q7" * long + " r", "one two " * long, "", "end"]
    got = hash_embed_texts(texts)
    assert len(got) == len(texts) and hash_embed_texts([]) == []
    for text, vector in zip(texts, got):
        counts = np.zeros(128)
        for token, times in Counter(re.findall("[a-z0-9]+", text)).items():
            bucket = 0
            for ch in token:
                bucket = (bucket * 31 + ord(ch)) % 128
            counts[bucket] += times
        norm = np.sqrt((counts * counts).sum())
        expected = (counts / norm if norm else counts).astype(np.float32)
        assert vector.dtype == np.float32 and np.array_equal(vector, expected)


def test_embedding_of_no_rows(spark):
    none = spark.createDataFrame([], "id int, text string")
    assert embed(none, "text", hash_embedder(), refuse_blank=True).collect() == []


def test_user_embedder_batches_and_counts(spark):
    df = spark.createDataFrame([(i, f" text {i} ") for i in range(40)], "id int, text string")

    def lengths(texts):
        assert len(texts) <= 16
        return [[float(len(t)), 1.0] for t in texts]

    rows = embed(df, "text", Embedder("len", lengths)).collect()
    assert {r.id: r.embedding[0] for r in rows}[11] == 7.0
    short = embed(df, "text", Embedder("short", lambda t: [[1.0]] * (len(t) - 1))).collect()
    assert {(r.embedding, r.model_id) for r in short} == {(None, "error:EMBEDDING_COUNT_MISMATCH")}


def test_texts_at_fault_cost_the_others_nothing(spark):
    calls = []

    def moody(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("EMBEDDING_RATE_LIMIT: later")
        return [None if t == "none" else [1.0, 2.0, 3.0] if t == "long" else [float(len(t)), 1.0] for t in texts]

    texts = [f"t{i}" for i in range(30)] + ["bad", "none", "long"]
    found = embed_each(texts, Embedder("m", moody, dimension=2))
    assert [list(v) for v in found[:30]] == [[float(len(t)), 1.0] for t in texts[:30]]
    assert found[30:] == ["EMBEDDING_RATE_LIMIT", "EMBEDDING_INVALID_VALUE", "EMBEDDING_DIMENSION_MISMATCH"]
    assert len(calls) <= 1 + 2 * 6  # halves only around the one at fault
    df = spark.createDataFrame([(1, None), (2, " \t"), (3, "x")], "id int, text string")
    told = embedding_errors(embed(df, "text", Embedder("m", lambda t: [[1.0]] * len(t)), refuse_blank=True)).collect()
    assert [(r.id, r.error_code, r.error_status) for r in told] == [(1, "EMPTY_EMBEDDING_INPUT", 400), (2, "EMPTY_EMBEDDING_INPUT", 400), (3, None, None)]


def test_vector_validation(spark):
    rows = [(1, [1.0, 2.0]), (2, []), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    good, bad = validate_vectors(df)
    assert [r.id for r in good.collect()] == [1]
    assert {r.error_code for r in bad.collect()} == {"EMBEDDING_INVALID_VALUE"} and bad.count() == 4
    good, bad = validate_vectors(df, stored_dimension=3)
    assert good.count() == 0
    assert [r.error_code for r in bad.filter("id = 1").collect()] == ["INDEX_EMBEDDING_DIMENSION_CONFLICT"]
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, embedding array<float>")
    assert {r.error_code for r in validate_vectors(mixed)[1].collect()} == {"INDEX_EMBEDDING_DIMENSION_MISMATCH"}


def test_normalization(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    a, b = df.select(vx.l2_normalize(F.col("v")).alias("u")).collect()
    assert [round(x, 6) for x in a.u] == [0.6, 0.8] and b.u is None


def test_knn_is_exact_for_close_and_tiny_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    # Distances far below single precision apart, vectors of very different length, and zeros.
    near = [(base + rng.normal(size=64) * 1e-7) * s for s in (1.0, 1e-20, 1e3) for _ in range(60)]
    vectors = [np.float32(v).tolist() for v in near] + [[0.0] * 64] * 5
    chunks = [(f"c{i:04d}", f"d{i % 3}", i, v) for i, v in enumerate(vectors)]
    questions = [(i, np.float32(base * s).tolist()) for i, s in enumerate((1.0, 1e-20, 50.0))] + [(9, [0.0] * 64)]
    for metric in ("cosine", "l2", "ip"):
        got = {}
        for r in knn(spark.createDataFrame(questions, Q), spark.createDataFrame(chunks, C), 7, metric).collect():
            got.setdefault(r.question_id, []).append((r.distance, r.document_fingerprint, r.sequence, r.chunk_id))
        assert {q: sorted(v) for q, v in got.items()} == brute(questions, chunks, 7, metric)


def test_pairing_checks(spark):
    chunks = spark.createDataFrame([("a",), ("a",), ("b",)], "document_fingerprint string")
    vectors = spark.createDataFrame([("a", "m"), ("b", "m"), ("b", "n")], "document_fingerprint string, model_id string")
    assert missing_vectors(chunks, vectors).count() == 2
    assert [r.document_fingerprint for r in mixed_models(vectors).collect()] == ["b"]


def test_jobs_do_not_grow_with_blocks_of_questions(spark):
    questions, chunks = data(8, 60, 150)
    questions += [(1000 + i, v) for i, v in questions]  # copies are answered too
    asked, corpus = spark.createDataFrame(questions, Q), spark.createDataFrame(chunks, C)
    context = spark.sparkContext
    context.setJobGroup("blocks-of-one", "")
    try:
        got = knn(asked, corpus, 4, "cosine", EngineConfig(broadcast_questions=1)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == sorted(map(tuple, knn(asked, corpus, 4).collect()))
    assert len(got) == 480 and len(context.statusTracker().getJobIdsForGroup("blocks-of-one")) < 60


def test_pieces_meet_in_blocks_that_fit_the_cache():
    rng = np.random.default_rng(3)
    asked, stored = (rng.normal(size=(2048, 32)).astype(np.float32) for _ in range(2))
    stored[5], asked[9] = 0, 0
    for metric in ("cosine", "l2", "ip"):
        one = _Asked(np.arange(2048).tobytes(), asked.tobytes(), 3, metric)
        for half in (0, 1):
            rows = slice(1024 * half, 1024 * half + 1024)
            numbers = np.arange(2048)[rows]
            row = {"numbers": numbers.tobytes(), "vectors": stored[rows].tobytes(), "own": numbers.tobytes(), "owned": np.ones(1024, bool).tobytes()}
            piece = _Piece(row, 3, metric, True)
            tracemalloc.start()
            one.meet(piece, metric, True)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert half == 0 or peak < 6 * 2**20  # all products at once hold 8 MB
        for q in (0, 9, 700, 2047):
            far = _exact(np.repeat(asked[q : q + 1], 2048, axis=0).astype(float), stored.astype(float), metric)
            far[q] = np.inf
            assert one.number[q].tolist() == np.lexsort((np.arange(2048), far))[:3].tolist()


def test_bytes_of_a_piece_reach_a_task_once(spark):
    """Six pieces of chunks in two tasks' shares meet five of questions in one."""
    chunks = spark.range(6).select(*[F.lit(b"c").alias(c) for c in ("numbers", "vectors", "own", "owned")])
    asked = spark.range(5).select(F.lit(b"q").alias("ids"), F.lit(b"q").alias("asked"))
    chunks = chunks.repartition(2).withColumn("piece", F.monotonically_increasing_id())
    asked = asked.repartition(1).withColumn("place", F.monotonically_increasing_id())
    pairs = _sent_once(chunks.crossJoin(asked.hint("shuffle_replicate_nl"))).cache()
    tasks = pairs.select(F.shiftright("piece", 33).alias("task")).distinct().count()
    assert pairs.count() == 30 and pairs.filter("vectors is not null").count() == 6
    assert pairs.filter("numbers is not null").count() == 6
    assert pairs.filter("asked is not null").count() == pairs.filter("ids is not null").count() == 5 * tasks


def test_places_of_near_pairs():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (3, 5), (8, 16), (7, 100)):
        for share in (0.0, 0.1, 1.0):
            keep = rng.random(shape) < share
            assert _places(keep).tolist() == np.flatnonzero(keep).tolist()
