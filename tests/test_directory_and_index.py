"""The store's directory, pruned reads, index batches, and the overview by version."""

import uuid

import pytest
from pyspark.sql import functions as F

from pagewright import EngineConfig
from pagewright.plans.index import index_with_vectors, pair_errors
from pagewright.plans.ingest import ingest
from pagewright.session import scratch_path
from pagewright.sources.store import ChunkStore
from pagewright.streaming import answer as answering

CHUNK = (
    "chunk_id string, document_fingerprint string, filename string, text string, start_page int, end_page int, "
    "sequence int, word_count int, source_boundaries array<string>, document_page_count int"
)


def rows(docs, chunks=3):
    return [(f"{d}-{i}", d, f"{d}.pdf", f"text {i}", i, i, i, 2, ["sentence"], chunks) for d in docs for i in range(1, chunks + 1)]


def stored(spark, docs, chunks=3):
    table = spark.createDataFrame(rows(docs, chunks), CHUNK)
    return table.withColumns({"embedding": F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"), "model_id": F.lit("m")})


@pytest.fixture
def store(spark):
    return ChunkStore(spark, scratch_path(spark, "store"))


def scans(df):
    """The file scans of a plan, as text."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [part for part in plan.split("\n\n") if "Scan parquet" in part and "ReadSchema" in part]


def test_directory_tells_what_a_scan_would(spark, store):
    store.append(stored(spark, [f"d{i}" for i in range(30)]), "one")
    store.append(stored(spark, [f"d{i}" for i in range(20, 50)], 2), "two")
    store.delete(spark.createDataFrame([("d7",), ("d45",)], "document_fingerprint string"))
    store.append(stored(spark, ["d7"], 5), "three")
    counted = {r.document_fingerprint: r["count"] for r in store.chunks().groupBy("document_fingerprint").count().collect()}
    assert {r.document_fingerprint: r.chunk_count for r in store.directory().collect()} == counted
    assert counted["d7"] == 5 and counted["d22"] == 3 and "d45" not in counted and store.count() == sum(counted.values())
    for many in (["d7", "d22", "d45", "none"], [f"d{i}" for i in range(0, 50, 3)]):
        asked = spark.createDataFrame([(d,) for d in many], "document_fingerprint string")
        got = sorted(r.chunk_id for r in store.chunks(asked).collect())
        assert got == sorted(r.chunk_id for r in store.chunks().collect() if r.document_fingerprint in many)
    assert [r.sequence for r in store.document_chunks("d7").collect()] == [1, 2, 3, 4, 5]
    assert sorted(r.chunk_id for r in store.chunk_ids("d22").collect()) == ["d22-1", "d22-2", "d22-3"]
    assert store.chunk_ids("nobody").collect() == []


def test_given_documents_are_pushed_to_their_buckets(spark, store):
    store.append(stored(spark, [f"d{i}" for i in range(40)]), "one")
    store.append(stored(spark, [f"e{i}" for i in range(40)]), "two")
    found = store.chunks(spark.createDataFrame([("d3",)], "document_fingerprint string"))
    (scan,) = scans(found)
    bucket = store.directory().filter("document_fingerprint = 'd3'").first().bucket
    assert str(bucket) in next(line for line in scan.split("\n") if "PartitionFilters" in line and "bucket#" in line)
    assert "PushedFilters" in scan and "document_fingerprint" in scan.split("PushedFilters")[1].split("\n")[0]
    assert "/folder=two" not in scan
    folders = {r[0].split("/folder=")[1].split("/")[0] for r in found.select(F.input_file_name()).collect()}
    assert len(folders) == 1 and folders.pop().startswith("one-")


def test_appends_read_the_directory_only(spark, store, monkeypatch):
    store.append(stored(spark, ["a", "b"]), "one")
    monkeypatch.setattr(ChunkStore, "chunks", lambda *a, **k: pytest.fail("read the chunks"))
    store.append(stored(spark, ["b", "c"]), "two")
    assert {(r.document_fingerprint, r.error_code) for r in store.rejected("two").collect()} == {("b", "DOCUMENT_ALREADY_INDEXED")}
    assert store.count() == 9 and store.dimension() == 2 and not store.is_empty()


def test_a_batch_replayed_after_compaction_reports_the_same(spark, store):
    pages = spark.createDataFrame(
        [("x" * 64, "x.pdf", 1, "One sentence here."), ("y" * 64, "y.pdf", 1, "Another one there.")],
        "document_id string, filename string, page_number int, text string",
    )
    told = sorted(map(tuple, ingest(pages, store, batch="b1").collect()))
    assert {r[7] for r in told} == {"indexed"}
    store.compact()
    assert sorted(map(tuple, ingest(pages, store, batch="b1").collect())) == told and store.count() == 2
    store.vacuum()
    assert sorted(map(tuple, ingest(pages, store, batch="b1").collect())) == told
    assert {r.status for r in ingest(pages, store, batch="b2").collect()} == {"already_indexed"}


def units(spark, chunk_rows, vector_rows):
    chunks = spark.createDataFrame(chunk_rows, f"batch_id string, {CHUNK}")
    vectors = spark.createDataFrame(vector_rows, "batch_id string, chunk_id string, embedding array<float>, model_id string")
    return chunks, vectors


def test_every_fault_of_an_index_batch(spark, store):
    store.append(stored(spark, ["old"]), "before")
    chunk_rows = [(b, *r) for b in ("ok", "few", "swap", "twice", "nan", "long", "late") for r in rows([b])]
    chunk_rows += [("mixed", *r) for r in rows(["m1", "m2"], 1)] + [("had", *r) for r in rows(["old"])] + [("zz", *r) for r in rows(["late"])]
    vector_rows = [(r[0], r[1], [1.0, float(i)], "m") for i, r in enumerate(chunk_rows)]
    vector_rows = [v for v in vector_rows if v[:2] != ("few", "few-2")]
    vector_rows = [(v[0], "other" if v[1] == "swap-1" else v[1], *v[2:]) for v in vector_rows]
    vector_rows += [("twice", "twice-1", [1.0, 1.0], "m"), ("none", "n-1", [1.0, 1.0], "m")]
    vector_rows = [(b, c, [float("nan"), 1.0] if c == "nan-1" else e * (2 if c == "long-1" else 1), m) for b, c, e, m in vector_rows]
    report = {r.batch_id: (r.indexed_count, r.error_code, r.error_status) for r in index_with_vectors(*units(spark, chunk_rows, vector_rows), store, "b").collect()}
    assert report == {
        "ok": (3, None, None),
        "late": (3, None, None),
        "few": (0, "CHUNK_EMBEDDING_COUNT_MISMATCH", 500),
        "swap": (0, "CHUNK_EMBEDDING_COUNT_MISMATCH", 500),
        "twice": (0, "CHUNK_EMBEDDING_COUNT_MISMATCH", 500),
        "none": (0, "NO_CHUNKS_TO_INDEX", 422),
        "mixed": (0, "MIXED_DOCUMENT_CHUNKS", 500),
        "had": (0, "DOCUMENT_ALREADY_INDEXED", 409),
        "zz": (0, "DOCUMENT_ALREADY_INDEXED", 409),
        "nan": (0, "EMBEDDING_INVALID_VALUE", 502),
        "long": (0, "INDEX_EMBEDDING_DIMENSION_MISMATCH", 502),
    }
    kept = {r.chunk_id: r.embedding[1] for r in store.chunks().collect()}
    own = {v[1]: v[2][1] for v in vector_rows if v[0] in ("ok", "late")}
    assert {c: kept[c] for c in own} == own and len(kept) == 9


def test_one_unit_with_most_rows_and_empty_tables(spark, store):
    chunk_rows = [("big", *r) for r in rows(["big"], 3000)] + [("s", *r) for r in rows(["s"], 2)]
    vector_rows = [(r[0], r[1], [1.0, 0.0], "m") for r in chunk_rows]
    chunks, vectors = units(spark, chunk_rows, vector_rows[:-1])
    report = {r.batch_id: (r.indexed_count, r.error_code) for r in index_with_vectors(chunks, vectors, store).collect()}
    assert report == {"big": (3000, None), "s": (0, "CHUNK_EMBEDDING_COUNT_MISMATCH")}
    chunks, vectors = units(spark, chunk_rows, vector_rows[1:])
    other = ChunkStore(spark, scratch_path(spark, "store"))
    assert {r.batch_id: r.indexed_count for r in index_with_vectors(chunks, vectors, other).collect()} == {"big": 0, "s": 2}
    assert pair_errors(chunks.limit(0), vectors.limit(0)).collect() == []
    assert index_with_vectors(chunks.limit(0), vectors.limit(0), other).collect() == []


def test_the_overview_is_made_once_per_version(spark, store, monkeypatch):
    store.append(stored(spark, ["a", "b"]), "one")
    folder, cfg, made = scratch_path(spark, "overviews"), EngineConfig(), []
    fresh = answering.store_overview
    monkeypatch.setattr(answering, "store_overview", lambda *a: made.append(1) or fresh(*a))
    first = answering.kept_overview(store, folder, cfg, store.snapshot()).collect()
    again = answering.kept_overview(store, folder, cfg, store.snapshot()).collect()
    assert first == again and len(made) == 1 and first[0].total_documents == 2
    store.append(stored(spark, [uuid.uuid4().hex]), "two")
    assert answering.kept_overview(store, folder, cfg, store.snapshot()).first().total_documents == 3 and len(made) == 2
