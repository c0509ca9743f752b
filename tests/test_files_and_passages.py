"""Files through to the report, faults of embedding inside an ingest, passages in chunks."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.operators import evaluation
from pagewright.operators.embedding import Embedder
from pagewright.operators.evaluation import passages_in
from pagewright.plans.ingest import ingest, ingest_files
from pagewright.session import scratch_path
from pagewright.sources.files import scan_files
from pagewright.sources.store import ChunkStore

PAGES = "path string, page_number int, text string"


def test_scanned_files_through_to_the_report(spark, tmp_path):
    contents = {
        "a.pdf": b"%PDF-1.4 one", "copy of a.pdf": b"%PDF-1.4 one", "b.pdf": b"no signature", "c.txt": b"%PDF-1.4 c",
        "big.pdf": b"%PDF-1.4" + b"x" * 5000, "scan.pdf": b"%PDF-1.4 image", "bare.pdf": b"%PDF-1.4 bare",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    cfg = EngineConfig(max_upload_size_bytes=1000)
    files = scan_files(spark, str(tmp_path), cfg)
    by_name = {r.filename: r.path for r in files.select("path", "filename").collect()}
    assert {r.content for r in files.filter("filename = 'big.pdf'").collect()} == {None}
    rows = [(by_name[n], i, f"Page {i} of the file. It has two sentences.") for n in ("a.pdf", "copy of a.pdf", "b.pdf", "big.pdf") for i in (1, 2)]
    pages = spark.createDataFrame([*rows, (by_name["scan.pdf"], 1, " \n"), ("elsewhere", 1, "Unknown file.")], PAGES)
    store = ChunkStore(spark, scratch_path(spark, "store"))
    report = {r.filename: r for r in ingest_files(files, pages, store, cfg=cfg).collect()}
    assert set(report) == set(contents)
    told = {n: (r.status, r.error_code) for n, r in report.items()}
    assert sorted((told.pop("a.pdf"), told.pop("copy of a.pdf"))) == [("already_indexed", None), ("indexed", None)]
    assert told == {
        "b.pdf": ("rejected", "INVALID_PDF_SIGNATURE"),
        "c.txt": ("rejected", "INVALID_FILENAME"),
        "big.pdf": ("rejected", "FILE_TOO_LARGE"),
        "scan.pdf": ("rejected", "NO_EXTRACTABLE_TEXT"),
        "bare.pdf": ("rejected", "NO_EXTRACTABLE_TEXT"),
    }
    assert report["a.pdf"].document_id == hashlib.sha256(contents["a.pdf"]).hexdigest() and report["a.pdf"].page_count == 2
    assert {r.document_fingerprint for r in store.chunks().collect()} == {report["a.pdf"].document_id}


def test_a_failing_embedder_rejects_its_documents_by_code(spark):
    pages = spark.createDataFrame(
        [(c * 64, f"{c}.pdf", 1, f"The {w} sentence.") for c, w in (("a", "good"), ("b", "slow"), ("c", "odd"))],
        "document_id string, filename string, page_number int, text string",
    )

    def moody(texts):
        if any("slow" in t for t in texts):
            raise TimeoutError("EMBEDDING_TIMEOUT")
        return [[float("nan")] if "odd" in t else [1.0] for t in texts]

    store = ChunkStore(spark, scratch_path(spark, "store"))
    report = {r.filename: (r.status, r.error_code) for r in ingest(pages, store, Embedder("moody", moody)).collect()}
    assert report == {"a.pdf": ("indexed", None), "b.pdf": ("rejected", "EMBEDDING_TIMEOUT"), "c.pdf": ("rejected", "EMBEDDING_INVALID_VALUE")}
    assert store.count() == 1 and store.chunks().count() == 1


def test_passages_stand_word_by_word(spark):
    long = " ".join(f"w{i}" for i in range(40))
    chunks = spark.createDataFrame(
        [("1", "d1", f"x {long}  y"), ("2", "d2", long.replace("w30", "z")), ("3", "d3", "one two\nthree"), ("4", "d3", ""), ("5", "d1", "two three one two")],
        "chunk_id string, document_fingerprint string, text string",
    )
    passages = spark.createDataFrame([(long,), ("two three",), ("one  two",), ("wo three",), ("",), (None,), ("w3 w4 w5 w6 w7 w8 w9 w10 w11",)], "passage string")
    found = {tuple(r) for r in passages_in(chunks, passages).collect()}
    nine = "w3 w4 w5 w6 w7 w8 w9 w10 w11"
    assert found == {(long, "d1"), ("two three", "d1"), ("two three", "d3"), ("one  two", "d1"), ("one  two", "d3"), (nine, "d1"), (nine, "d2")}
    assert passages_in(chunks, passages.filter(F.lit(False))).collect() == []


def test_windows_are_dropped_before_they_are_shuffled(spark):
    chunks = spark.createDataFrame(
        [(str(i), f"d{i % 3}", " ".join(f"w{(i * j) % 11}" for j in range(30))) for i in range(40)],
        "chunk_id string, document_fingerprint string, text string",
    )
    passages = spark.createDataFrame([("w1 w2 w3",), ("w0 w5",), ("w7",), ("w9 w1 w1",)], "passage string")
    found = passages_in(chunks, passages)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in passages_in(chunks, passages, broadcast_keys=0).collect()}
    assert found.count() > 0


def test_windows_that_meet_no_passage_become_no_rows():
    texts = ["größe x größe y", "", "a b c d", "x", "b c größe x"]
    batch = pa.record_batch([pa.array(["d1", "d2", "d3", "d4", "d5"]), pa.array(texts)], ["document_fingerprint", "text"])
    wanted = pa.record_batch([pa.array(["p", "q", "r"]), pa.array(["größe x", "b c d e", "x"])], ["passage", "wanted"])
    told = [r for b in evaluation._with_keys(2)(iter([wanted])) for r in b.to_pylist()]
    assert [(r["words"], r["width"]) for r in told] == [(2, 2), (4, 2), (1, 1)]
    bits = np.zeros((1 << 26) // 64, np.uint64)
    for r in told:
        bit = r["key"] % 2**64 >> 38
        bits[bit >> 6] |= np.uint64(1 << (bit & 63))
    rows = [r for b in evaluation._windows([1, 2], 3, bits)(iter([batch])) for r in b.to_pylist()]
    keys = {r["key"]: r["passage"] for r in told}
    assert sorted((r["document_fingerprint"], keys[r["key"]], r["said"]) for r in rows) == [
        ("d1", "p", "größe x größe"), ("d1", "r", "x größe y"), ("d3", "q", "b c d"), ("d4", "r", "x"),
        ("d5", "p", "größe x"), ("d5", "q", "b c größe"), ("d5", "r", "x"),
    ]
