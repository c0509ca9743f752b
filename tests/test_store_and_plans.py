import itertools
import uuid

import pytest
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.operators.embedding import Embedder
from pagewright.plans.answer import Generator, answer_batch
from pagewright.plans.ingest import ingest
from pagewright.schemas import STORED_CHUNK
from pagewright.sources.sinks import answer_payloads, write_listing, write_signature
from pagewright.sources.store import ChunkStore, StoreError, count_mismatches, insert_if_absent
from pagewright.sources.tables import questions_from_requests, stream_pages
from pagewright.streaming.answer import answer_stream
from pagewright.streaming.ingest import ingest_stream
from pagewright.operators.documents import corpus_signature, corpus_summary, list_documents

PAGES = "upload_id long, document_id string, filename string, page_number int, text string"
REPORT = "Quarterly Growth Report\nRevenue grew by ten percent in the last year. Costs fell slightly. The outlook is stable."


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store"))


def chunk_rows(spark, rows):
    full = [
        (c, d, f"{d}.pdf", f"text {c}", 1, 2, s, 2, ["sentence"], 5, v, "m") for c, d, s, v in rows
    ]
    return spark.createDataFrame(full, STORED_CHUNK)


EXAMPLE = [("a", "d1", 1, [1.0, 0.0]), ("b", "d1", 2, [0.0, 1.0]), ("c", "d2", 1, [1.0, 1.0])]


def ids(df):
    return sorted(r.chunk_id for r in df.collect())


def test_store_life(spark, store):
    assert store.is_empty() and store.dimension() is None and store.count() == 0
    store.append(chunk_rows(spark, EXAMPLE))
    again = ChunkStore(spark, store.root)
    assert ids(again.chunks()) == ["a", "b", "c"] and again.dimension() == 2
    assert [(r.filename, r.page_count, r.chunk_count) for r in list_documents(again.chunks()).collect()] == [
        ("d1.pdf", 5, 2),
        ("d2.pdf", 5, 1),
    ]
    assert ids(store.chunk_ids("d1")) == ["a", "b"]
    assert [r.sequence for r in store.document_chunks("d1").collect()] == [1, 2]
    d1 = spark.createDataFrame([("d1",)], "document_fingerprint string")
    store.delete(d1)
    assert ids(store.chunks()) == ["c"]
    # A document may come back after its deletion.
    store.append(chunk_rows(spark, [("a2", "d1", 1, [1.0, 0.0])]))
    assert ids(store.chunks()) == ["a2", "c"] and ids(store.chunks(d1)) == ["a2"]
    store.delete(spark.createDataFrame([("d2",)], "document_fingerprint string"))
    store.append(chunk_rows(spark, [("x", "d3", 1, [1.0, 0.0])]))
    assert ids(store.chunks()) == ["a2", "x"]
    store.compact()
    assert ids(store.chunks()) == ["a2", "x"] and len(store.snapshot().batches) == 1
    store.reset()
    assert store.is_empty() and store.dimension() is None


def test_batches_are_idempotent_and_checked(spark, store):
    store.append(chunk_rows(spark, EXAMPLE), batch="one")
    version = store.append(chunk_rows(spark, EXAMPLE), batch="one")
    assert store.count() == 3 and version == store.snapshot().version
    bad = [
        ("e", "d4", 1, [1.0, 0.0]),
        ("f", "d5", 1, [1.0, 0.0, 0.0]),
        ("g", "d6", 1, [float("nan"), 0.0]),
        ("h", "d7", 1, [1.0]),
        ("i", "d7", 2, [1.0, 2.0]),
    ]
    store.append(chunk_rows(spark, bad), batch="two")
    assert ids(store.chunks()) == ["a", "b", "c", "e"]
    assert {r.document_fingerprint: r.error_code for r in store.rejected("two").collect()} == {
        "d5": "INDEX_EMBEDDING_DIMENSION_CONFLICT",
        "d6": "EMBEDDING_INVALID_VALUE",
        "d7": "INDEX_EMBEDDING_DIMENSION_MISMATCH",
    }
    assert store.rejected("one").count() == 0


def test_set_operations(spark):
    old, new = chunk_rows(spark, EXAMPLE[:2]), chunk_rows(spark, EXAMPLE[1:] + EXAMPLE[2:])
    assert ids(insert_if_absent(new, old)) == ["c"]
    wrong = count_mismatches(chunk_rows(spark, EXAMPLE[1:]), chunk_rows(spark, EXAMPLE)).collect()
    assert [(r.document_fingerprint, r.expected, r.actual) for r in wrong] == [("d1", 2, 1)]
    assert StoreError("X", {"a": 1}).details == {"a": 1}


def test_corpus_views(spark, tmp_path):
    chunks = chunk_rows(spark, EXAMPLE)
    row = corpus_summary(chunks).first()
    assert (row.documents, row.chunks, row.pages, row.label) == (2, 3, 10, "2 documents")
    assert corpus_summary(chunks.filter("document_fingerprint = 'd2'")).first().label == "d2.pdf"
    assert corpus_summary(chunks.limit(0)).first().label == "None indexed"
    signature = corpus_signature(chunks).first().signature
    assert signature == corpus_signature(chunks.repartition(3)).first().signature
    assert signature != corpus_signature(chunks.filter("sequence = 2")).first().signature
    write_signature(chunks.coalesce(1), str(tmp_path / "sig"))
    assert [r.value for r in spark.read.option("wholetext", True).text(str(tmp_path / "sig")).collect()] == ["d1|d2|"]
    write_listing(chunks, str(tmp_path / "list"))
    assert spark.read.json(str(tmp_path / "list")).count() == 2


def upload(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_ingest_reports_and_deduplicates(spark, store):
    pages = upload(
        spark,
        [
            (1, "fp1", "report.pdf", 1, REPORT),
            (1, "fp1", "report.pdf", 2, REPORT),
            (2, "fp1", "copy.pdf", 1, REPORT),
            (2, "fp1", "copy.pdf", 2, REPORT),
            (3, "fp2", "scan.pdf", 1, " \x07\n "),
            (3, "fp2", "scan.pdf", 2, ""),
            (4, "fp3", "other.pdf", 1, "Short note. With two sentences."),
        ],
    )
    rows = {r.upload_id: r for r in ingest(pages, store).collect()}
    assert (rows[1].status, rows[1].page_count, rows[1].chunk_count) == ("indexed", 2, 2)
    assert rows[1].message.endswith("2 pages processed, 2 chunks created, 2 vectors indexed.")
    assert (rows[2].status, rows[2].filename, rows[2].indexed_count) == ("already_indexed", "copy.pdf", 2)
    assert (rows[3].status, rows[3].error_code, rows[3].empty_page_count) == ("rejected", "NO_EXTRACTABLE_TEXT", 1)
    assert rows[4].status == "indexed"
    version, before = store.snapshot().version, sorted(map(tuple, store.chunks().drop("embedding", "source_boundaries").collect()))
    again = ingest(pages, store)
    assert {r.status for r in again.filter("upload_id != 3").collect()} == {"already_indexed"}
    assert store.snapshot().version == version
    assert sorted(map(tuple, store.chunks().drop("embedding", "source_boundaries").collect())) == before


def test_ingest_keeps_documents_with_bad_vectors_out(spark, store):
    pages = upload(spark, [(1, "fp1", "a.pdf", 1, "Good text."), (2, "fp2", "b.pdf", 1, "Bad text.")])
    embedder = Embedder("odd", lambda ts: [[float("nan") if t.startswith("Bad") else 1.0, 0.0] for t in ts])
    rows = {r.upload_id: r for r in ingest(pages, store, embedder).collect()}
    assert rows[1].status == "indexed"
    assert (rows[2].status, rows[2].error_code) == ("rejected", "EMBEDDING_INVALID_VALUE")
    assert [r.document_fingerprint for r in store.chunks().collect()] == ["fp1"]


@pytest.fixture
def indexed(spark, store):
    ingest(upload(spark, [(1, "fp1", "report.pdf", p, REPORT) for p in (1, 2)]), store)
    return store


def ask(spark, store, *questions, **kw):
    df = spark.createDataFrame(list(enumerate(questions, 1)), "question_id long, question string")
    return answer_batch(df, store.chunks(), **kw)


def test_answer_routes(spark, indexed):
    cfg = EngineConfig(relevance_threshold=0.95)
    answers, rejected = ask(
        spark, indexed, "How much did revenue grow?", "What is this document about?", " ", None, "x" * 10001, cfg=cfg
    )
    a = {r.question_id: r for r in answers.collect()}
    assert set(a) == {1, 2}
    assert (a[1].status, a[1].mode) == ("answered", "retrieval")
    assert a[1].answer == "FAKE-ANSWER for: How much did revenue grow?"
    assert [s["rank"] for s in a[1].sources] == list(range(1, len(a[1].sources) + 1))
    assert (a[2].status, a[2].mode) == ("answered", "document_overview")
    assert a[2].candidate_count == a[2].accepted_count == a[2].top_k == len(a[2].sources) == 2
    assert {r.question_id: r.error_code for r in rejected.collect()} == {
        3: "EMPTY_QUESTION",
        4: "VALIDATION_ERROR",
        5: "VALIDATION_ERROR",
    }
    assert '"retrieval":{"candidates":' in answer_payloads(answers).first().payload


def test_all_outcomes(spark, indexed):
    sure = lambda pairs: ["fine" for _ in pairs]
    unsure = lambda pairs: ["\n insufficient_evidence" if "8. This" in s else "fine" for s, _ in pairs]
    tight = EngineConfig(relevance_threshold=0.0001)
    cases = {
        "fallback answered": (tight, sure, ("answered", "document_overview", 2, 2, "fine")),
        "fallback gave up": (tight, unsure, ("abstained", "retrieval", 2, 0, None)),
        "no fallback": (
            EngineConfig(relevance_threshold=0.0001, enable_overview_fallback=False),
            sure,
            ("abstained", "retrieval", 2, 0, None),
        ),
        "nothing fits": (
            EngineConfig(relevance_threshold=1.0, max_context_tokens=1),
            sure,
            ("abstained", "retrieval", 2, 2, None),
        ),
    }
    for name, (cfg, model, (status, mode, candidates, accepted, said)) in cases.items():
        row = ask(spark, indexed, "How much did revenue grow?", cfg=cfg, generator=Generator(model))[0].first()
        assert (row.status, row.mode, row.candidate_count, row.accepted_count) == (status, mode, candidates, accepted), name
        if said is None:
            assert row.answer.startswith("The uploaded document does not provide") and row.sources == []
            assert row.context_token_estimate == 0
        else:
            assert row.answer == said


def test_prompt_numbering_differs_from_rank(spark, store):
    far = "Alpha beta gamma. Alpha beta gamma delta epsilon zeta eta theta."
    near = "Alpha beta gamma."
    ingest(upload(spark, [(1, "fp1", "a.pdf", 1, far), (2, "fp2", "b.pdf", 1, near)]), store)
    answers, _ = ask(
        spark, store, "alpha beta gamma", generator=Generator(lambda pairs: [u for _, u in pairs])
    )
    row = answers.first()
    assert [s["filename"] for s in row.sources] == ["b.pdf", "a.pdf"]
    assert row.answer.index("filename: a.pdf") < row.answer.index("filename: b.pdf")
    assert "[SOURCE 1]\nsource_id: fp1:chunk_" in row.answer


def test_questions_before_any_upload(spark, store):
    answers, rejected = ask(spark, store, "Anything?", "")
    assert answers.count() == 0
    assert {r.question_id: (r.error_code, r.error_status) for r in rejected.collect()} == {
        1: ("NO_DOCUMENTS_INDEXED", 409),
        2: ("VALIDATION_ERROR", 422),
    }


def test_request_bodies(spark):
    bodies = ['{"question": "Why?"}', '{"question": 5}', '{"question": null}', "{}", "not json", '{"question": ""}']
    df = spark.createDataFrame(list(enumerate(bodies)), "question_id long, body string")
    got = {r.question_id: (r.question, r.question_type) for r in questions_from_requests(df).collect()}
    assert got == {
        0: ("Why?", "string"),
        1: (None, "other"),
        2: (None, "missing"),
        3: (None, "missing"),
        4: (None, "missing"),
        5: ("", "string"),
    }


def test_streams_equal_batches(spark, tmp_path):
    rows = [
        (d * 10, f"fp{d % 5}", f"{d}.pdf", p, f"Page {p} of {d % 5}. {REPORT}") for d, p in itertools.product(range(7), (1, 2))
    ]
    incoming = tmp_path / "incoming"
    for d in range(7):
        upload(spark, [r for r in rows if r[0] == d * 10]).coalesce(1).write.parquet(str(incoming / f"u={d}"))
    schema = spark.createDataFrame([], PAGES).schema
    live = ChunkStore(spark, str(tmp_path / "live"))
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(incoming / "*"))
    ingest_stream(pages, live, str(tmp_path / "cp1"), str(tmp_path / "reports")).awaitTermination()
    once = ChunkStore(spark, str(tmp_path / "once"))
    ingest(upload(spark, rows), once)
    assert ids(live.chunks()) == ids(once.chunks())
    reports = spark.read.parquet(str(tmp_path / "reports" / "*"))
    assert reports.filter("status = 'indexed'").count() == 5 and reports.count() == 7

    asked = tmp_path / "asked"
    questions = spark.createDataFrame(
        [(1, "How did revenue grow?"), (2, "summarize"), (3, "  ")], "question_id long, question string"
    )
    questions.write.parquet(str(asked))
    stream = spark.readStream.schema(questions.schema).parquet(str(asked))
    answer_stream(stream, live, str(tmp_path / "cp2"), str(tmp_path / "answers")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "answers")).drop("batch").orderBy("question_id").collect()
    want = answer_batch(questions, live.chunks())[0].orderBy("question_id").collect()
    assert got == want and len(got) == 2
    assert stream_pages(spark, str(asked)).isStreaming


def test_interrupted_batch_stays_invisible(spark, store):
    store.append(chunk_rows(spark, EXAMPLE))
    name = uuid.uuid4().hex
    chunk_rows(spark, [("z", "d9", 1, [1.0, 0.0])]).write.parquet(f"{store.root}/chunks/{name}")
    assert ids(store.chunks()) == ["a", "b", "c"]
    store.append(chunk_rows(spark, [("z", "d9", 1, [1.0, 0.0])]), batch=name)
    assert ids(store.chunks()) == ["a", "b", "c", "z"]
    assert store.chunks().filter(F.col("chunk_id") == "z").count() == 1
