import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewright.plans.ingest import ingest
from pagewright.sources.store import ChunkStore
from pagewright.streaming.parts import ingest_parts_stream

SCHEMA = (
    "upload_id string, document_id string, filename string, page_number int, text string, page_count int, "
    "last boolean, sent_at timestamp, batch int, _first string"
)


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds steps of pages, one micro-batch each, and returns store and report."""
    incoming, store = tmp_path / "in", ChunkStore(spark, str(tmp_path / "store"))

    def feed(*steps, wait=None):
        for rows in steps:
            full = [(*r, *[None] * (8 - len(r)), 7, "other") for r in rows]
            spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(str(incoming))
            source = spark.readStream.schema(SCHEMA).parquet(str(incoming))
            ingest_parts_stream(source, store, str(tmp_path / "check"), str(tmp_path / "report"), wait=wait).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "report/*")).collect()
        return store, {(r.upload_id, r.status, r.error_code) for r in found}

    return feed


def page(upload, document, number, count=None, last=None, sent=None):
    return (upload, document, f"{document}.pdf", number, f"Page {number} of {document}. It has a text.", count, last, sent)


def test_parts_equal_one_batch(spark, tmp_path, stream):
    steps = [
        [page("u1", "a", 2), page("u2", "b", 1, 1), page("u3", "c", 3, None, True)],
        [page("u1", "a", 3, 3), page("u1", "a", 2), page("u3", "c", 1)],
        [page("u1", "a", 1), page("u3", "c", 2), page("u4", "a", 1, 3), page("u4", "a", 2), page("u5", "d", 1, 2)],
        [page("u4", "a", 3)],
    ]
    store, told = stream(*steps)
    assert told == {(u, "indexed", None) for u in ("u1", "u2", "u3")} | {("u4", "already_indexed", None)}
    whole = {(r[0], r[3]): r[:5] for step in steps for r in step if r[0] in ("u1", "u2", "u3")}
    once = ChunkStore(spark, str(tmp_path / "once"))
    ingest(spark.createDataFrame(sorted(whole.values()), "upload_id string, document_id string, filename string, page_number int, text string"), once)
    key = ["chunk_id", "text", "start_page", "end_page"]
    assert sorted(store.chunks().select(key).collect()) == sorted(once.chunks().select(key).collect())
    # u5 waits; parts of it are the only ones that are kept.
    waiting = spark.read.parquet(str(tmp_path / "check-parts/waiting/batch=000000000003"))
    assert [r.upload_id for r in waiting.collect()] == ["u5"]
    kept = spark.read.parquet(str(tmp_path / "check-parts/pages"))
    assert kept.filter("upload_id = 'u5'").count() == 1


def test_late_wrong_and_missing_parts(spark, stream):
    noon = dt.datetime(2024, 1, 1, 12)
    later = noon + dt.timedelta(hours=3)
    store, told = stream(
        [page("u1", "a", 1, 1, None, noon), page("u2", "b", 3, 2), page("u3", "c", 1, 2, None, noon), page("u6", "f", None, 1)],
        [page("u1", "a", 2, 2), page(None, "n", 1, 1), page("u7", None, 1, 1), page("u8", "g", 1, 2), page("u8", "h", 2, 2)],
        [],
        [page("u4", "d", 1, 2, None, later)],
        [page("u4", "d", 2, None, None, later), page("u3", "c", 2, None, None, later)],
        wait="2 hours",
    )
    differ, missing = "DOCUMENT_PAGES_DIFFER", "DOCUMENT_PARTS_MISSING"
    assert told == {
        ("u1", "indexed", None), ("u1", "rejected", differ), ("u2", "rejected", differ), ("u6", "rejected", differ),
        (None, "rejected", differ), ("u7", "rejected", differ), ("u8", "rejected", differ),
        ("u3", "rejected", missing), ("u3", "rejected", differ), ("u4", "indexed", None),
    }
    assert {r.document_fingerprint for r in store.chunks().collect()} == {"a", "d"}


def test_a_batch_run_again_gives_what_it_gave(spark, tmp_path, stream):
    steps = [page("u1", "a", 1, 2)], [page("u1", "a", 2), page("u2", "b", 1, 1)]
    store, told = stream(*steps)
    # The commit mark of the last micro-batch is lost: it runs again.
    (tmp_path / "check/commits/1").unlink()
    for crc in (tmp_path / "check/commits").glob(".1.crc"):
        crc.unlink()
    before = sorted(r.chunk_id for r in store.chunks().collect())
    store, again = stream([page("u3", "c", 1, 1)])
    assert told <= again and again - told == {("u3", "indexed", None)}
    assert before == sorted(r.chunk_id for r in store.chunks().filter(F.col("document_fingerprint") != "c").collect())


def test_steps_arrive_in_many_files(spark, monkeypatch, tmp_path):
    from verification import queries

    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = spark.range(0, 80, 1, 4).selectExpr("id", "id % 2 as step")
    batches = []

    def start(source, work):
        def one_batch(batch, number):
            batches.append(sorted(r.id for r in batch.collect()))

        return source.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{work}/c").trigger(availableNow=True).start()

    queries._in_steps(spark, rows, 2, start)
    assert batches == [list(range(0, 80, 2)), list(range(1, 80, 2))]
    assert len(list((tmp_path / "incoming").glob("*.parquet"))) == 8
