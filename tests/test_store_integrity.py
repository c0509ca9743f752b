import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.operators.embedding import Embedder
from pagewright.operators.overview import even_positions
from pagewright.plans.answer import Generator, answer_batch
from pagewright.plans.ingest import ingest
from pagewright.session import scratch_path, scratch_scope, shared_folder
from pagewright.sources import store as store_module
from pagewright.sources.store import ChunkStore, StoreError
from pagewright.streaming.ingest import ingest_stream

from test_store_and_plans import EXAMPLE, PAGES, chunk_rows, ids


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store"))


def codes(store, batch):
    return {(r.document_fingerprint, r.error_code) for r in store.rejected(batch).collect()}


def test_chunks_are_stored_once(spark, store):
    store.append(chunk_rows(spark, [*EXAMPLE, EXAMPLE[0]]), "one")
    assert ids(store.chunks()) == ["a", "b", "c"]
    store.append(chunk_rows(spark, [*EXAMPLE, ("n", "d9", 1, [0.0, 2.0])]), "two")
    assert ids(store.chunks()) == ["a", "b", "c", "n"]
    assert codes(store, "two") == {("d1", "DOCUMENT_ALREADY_INDEXED"), ("d2", "DOCUMENT_ALREADY_INDEXED")}
    with pytest.raises(StoreError, match="NO_CHUNKS_TO_INDEX"):
        store.append(chunk_rows(spark, []), "three")
    version = store.snapshot().version
    assert store.append(chunk_rows(spark, []), "three", empty_ok=True) == version


def test_second_writer_of_a_version_tries_again(spark, store, monkeypatch):
    store.append(chunk_rows(spark, EXAMPLE[:1]), "one")
    other = ChunkStore(spark, store.root)
    publish, raced = store._commit, []

    def late(snap, action, **values):
        if not raced:
            raced.append(other.append(chunk_rows(spark, [("x", "d7", 1, [1.0, 1.0])]), "other"))
        return publish(snap, action, **values)

    monkeypatch.setattr(store, "_commit", late)
    store.append(chunk_rows(spark, [("x2", "d7", 1, [1.0, 1.0]), ("y", "d8", 1, [1.0, 2.0])]), "mine")
    assert ids(store.chunks()) == ["a", "x", "y"] and codes(store, "mine") == {("d7", "DOCUMENT_ALREADY_INDEXED")}


def test_checkpoints_and_vacuum(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "CHECKPOINT_EVERY", 3)
    for i in range(5):
        store.append(chunk_rows(spark, [(f"c{i}", f"d{i}", 1, [1.0, float(i)])]), f"b{i}")
    store.delete(spark.createDataFrame([("d1",)], "document_fingerprint string"))
    assert os.listdir(f"{store.root}/checkpoints") and ids(store.chunks()) == ["c0", "c2", "c3", "c4"]
    before = store.snapshot()
    store.compact()
    gone = store.vacuum()
    assert any(x.startswith("chunks/") for x in gone) and any(x.startswith("manifest/") for x in gone)
    fresh = ChunkStore(spark, store.root)
    assert ids(fresh.chunks()) == ["c0", "c2", "c3", "c4"] and fresh.snapshot().version == before.version + 1
    assert len([x for x in os.listdir(f"{store.root}/chunks") if not x.startswith(".")]) == 1
    store.append(chunk_rows(spark, [("z", "d1", 1, [2.0, 2.0])]), "again")
    assert ids(store.chunks()) == ["c0", "c2", "c3", "c4", "z"]


def pages_of(spark, folder, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(folder)


def report(spark, folder):
    return {(r.upload_id, r.status, r.error_code) for r in spark.read.option("recursiveFileLookup", "true").parquet(folder).collect()}


def test_streams_share_a_store_and_parts_are_refused(spark, store, tmp_path):
    def run(number, rows):
        source = pages_of(spark, str(tmp_path / f"in{number}"), rows)
        ingest_stream(source, store, str(tmp_path / f"check{number}"), str(tmp_path / f"report{number}")).awaitTermination()
        return report(spark, str(tmp_path / f"report{number}"))

    assert run(1, [(1, "fp1", "a.pdf", 1, "First page. It has text.")]) == {(1, "indexed", None)}
    assert run(2, [(2, "fp2", "b.pdf", 1, "Other text.")]) == {(2, "indexed", None)}
    # The usual recovery: the same stream with a fresh checkpoint.
    assert run(3, [(3, "fp3", "c.pdf", 1, "Third text."), (4, "fp2", "b.pdf", 1, "Other text.")]) == {
        (3, "indexed", None),
        (4, "already_indexed", None),
    }
    # A later part of a document is no duplicate.
    part = [(5, "fp1", "a.pdf", 2, "Second page."), (5, "fp1", "a.pdf", 3, "Third page.")]
    assert run(4, part) == {(5, "rejected", "DOCUMENT_PAGES_DIFFER")}
    assert {r.document_fingerprint for r in store.chunks().collect()} == {"fp1", "fp2", "fp3"}


def test_scratch_tables_go_with_their_micro_batch(spark, store, tmp_path):
    folder = f"{shared_folder(spark)}/pagewright"

    def count():
        return len(os.listdir(folder)) if os.path.isdir(folder) else 0

    rows = [(i, f"fp{i}", f"{i}.pdf", 1, f"Text number {i}.") for i in range(3)]
    for row in rows:
        source = pages_of(spark, str(tmp_path / "in"), [row])
    before = count()
    ingest_stream(source, store, str(tmp_path / "check"), str(tmp_path / "report")).awaitTermination()
    assert count() == before and store.count() == 3
    with scratch_scope(spark):
        spark.range(3).write.parquet(scratch_path(spark, "x"))
        assert count() == before + 1
    assert count() == before


def test_bad_question_vectors_fail_alone(spark, store):
    ingest(spark.createDataFrame([(1, "fp1", "a.pdf", 1, "Rivers flow. Mountains stand.")], PAGES), store)

    def vectors(texts):
        kinds = {"null": None, "empty": [], "nan": [float("nan")] * 128, "short": [1.0, 2.0, 3.0]}
        return [next((np.array(v, np.float32) if v is not None else None for k, v in kinds.items() if k in t), np.ones(128, np.float32)) for t in texts]

    names = ["what about null", "what about empty", "what about nan", "what about short", "how do rivers flow"]
    questions = spark.createDataFrame(list(enumerate(names)), "question_id long, question string")
    answers, rejected = answer_batch(questions, store.chunks(), Embedder("odd", vectors), cfg=EngineConfig())
    assert [r.question_id for r in answers.collect()] == [4]
    assert {(r.question_id, r.error_code, r.error_status) for r in rejected.collect()} == {
        (0, "EMBEDDING_INVALID_VALUE", 502),
        (1, "EMBEDDING_INVALID_VALUE", 502),
        (2, "EMBEDDING_INVALID_VALUE", 502),
        (3, "INDEX_EMBEDDING_DIMENSION_CONFLICT", 409),
    }


def test_generator_faults_cost_their_own_question(spark, store):
    ingest(spark.createDataFrame([(1, "fp1", "a.pdf", 1, "Rivers flow. Mountains stand.")], PAGES), store)

    def model(pairs):
        if any("broken" in user for _, user in pairs):
            raise RuntimeError("no answer")
        return ["fine" for _ in pairs]

    names = ["how do rivers flow", "broken rivers flow", "do mountains stand"]
    questions = spark.createDataFrame(list(enumerate(names)), "question_id long, question string")
    answers, rejected = answer_batch(questions, store.chunks(), generator=Generator(model))
    assert {(r.question_id, r.answer) for r in answers.collect()} == {(0, "fine"), (2, "fine")}
    assert [(r.question_id, r.error_code, r.error_status) for r in rejected.collect()] == [(1, "GENERATION_FAILED", 502)]


def test_one_even_position(spark):
    df = spark.createDataFrame([(5, 1), (5, 2), (1, 1)], "total int, lim int")
    rows = df.select(even_positions(F.col("total"), F.col("lim")).alias("p")).collect()
    assert [r.p for r in rows] == [[0], [0, 4], [0]]


def test_named_documents_are_looked_up_before_their_chunks(spark, store, monkeypatch):
    store.append(chunk_rows(spark, EXAMPLE), "one")
    moved, write = [], store._write_chunks
    monkeypatch.setattr(store, "_write_chunks", lambda df, path: (moved.append(df), write(df, path)))
    same = chunk_rows(spark, EXAMPLE)
    store.append(same, "again", documents=same)
    assert not moved and codes(store, "again") == {(d, "DOCUMENT_ALREADY_INDEXED") for d in ("d1", "d2")}
    new = chunk_rows(spark, [("n", "d9", 1, [0.0, 2.0])])
    store.append(new, "new", documents=new)
    assert "Join" not in moved[-1]._jdf.queryExecution().optimizedPlan().toString()
    both = chunk_rows(spark, [*EXAMPLE, ("m", "d8", 1, [2.0, 0.0])])
    store.append(both, "both", documents=both)
    assert ids(store.chunks()) == ["a", "b", "c", "m", "n"] and len(moved) == 2
    assert codes(store, "both") == {(d, "DOCUMENT_ALREADY_INDEXED") for d in ("d1", "d2")}
