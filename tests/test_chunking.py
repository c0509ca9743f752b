import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.operators import long_documents
from pagewright.operators.chunking import chunk_documents, flush_points
from pagewright.operators.units import page_units
from tests.brute_chunker import pack

FIELDS = ["sequence", "text", "start_page", "end_page", "word_count", "source_boundaries"]


def random_pages(seed, documents, max_pages):
    rng = random.Random(seed)
    rows = []
    for d in range(documents):
        for p in range(1, rng.randint(1, max_pages) + 1):
            parts = []
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if rng.random() < 0.3:
                    parts.append("%d.%d Part %d" % (rng.randint(1, 9), rng.randint(1, 9), p))
                if rng.random() < 0.15:
                    parts.append("KEY %s" % rng.choice(["POINTS", "RESULTS AND MORE"]))
                sentences = []
                for _ in range(rng.randint(1, 6)):
                    n = rng.choice([1, 2, 3, 5, 8, 13, 40])
                    sentences.append("Word" + "".join(" w%d" % rng.randint(0, 99) for _ in range(n - 1)) + ".")
                parts.append(" ".join(sentences))
            rows.append((f"doc{d}", f"doc{d}.pdf", p, "\n\n".join(parts)))
    return rows


def expected_chunks(spark, pages, target, overlap):
    units = page_units(pages, target).orderBy("document_id", "page_number", "unit_no").collect()
    by_doc = {}
    for u in units:
        by_doc.setdefault(u.document_id, []).append((u.kind, u.page_number, u.text.split(" ")))
    counts = {r.document_id: r["count"] for r in pages.groupBy("document_id").count().collect()}
    return {
        (doc, c["sequence"]): {**c, "document_page_count": counts[doc]}
        for doc, doc_units in by_doc.items()
        for c in pack(doc_units, target, overlap)
    }


def actual_chunks(chunks):
    return {
        (r.document_fingerprint, r.sequence): {
            **{f: r[f] for f in FIELDS},
            "document_page_count": r.document_page_count,
        }
        for r in chunks.collect()
    }


@pytest.mark.parametrize("target,overlap", [(12, 0), (12, 5), (30, 29), (60, 10), (500, 50)])
def test_matches_brute_force(spark, target, overlap):
    pages = spark.createDataFrame(
        random_pages(target, 40, 9), "document_id string, filename string, page_number int, text string"
    ).cache()
    cfg = EngineConfig(chunk_size=target, chunk_overlap=overlap)
    assert actual_chunks(chunk_documents(pages, cfg)) == expected_chunks(spark, pages, target, overlap)


@pytest.mark.parametrize(
    "target,overlap,folio,span", [(12, 5, 40, 2), (12, 0, 90, 3), (30, 29, 7, 3), (60, 10, 200, 2), (500, 50, 300, 2)]
)
def test_long_documents_match_brute_force(spark, target, overlap, folio, span):
    pages = spark.createDataFrame(
        random_pages(target * 100 + span, 12, 40), "document_id string, filename string, page_number int, text string"
    ).cache()
    cfg = EngineConfig(
        chunk_size=target, chunk_overlap=overlap, long_document_pages=5, folio_words=folio, folios_per_span=span
    )
    assert actual_chunks(chunk_documents(pages, cfg)) == expected_chunks(spark, pages, target, overlap)


def test_one_huge_page_and_many_small_ones_match_brute_force(spark):
    rng = random.Random(4)
    huge = " ".join("Word" + " w" * rng.choice([1, 3, 8, 70]) + "." for _ in range(900))
    rows = [("huge", "h.pdf", 1, "1.1 Part\n\n" + huge), ("huge", "h.pdf", 2, None), ("huge", "h.pdf", 3, "The end.")]
    rows += [("many", "m.pdf", p, f"Page {p} says something. And more.") for p in range(1, 400)]
    rows += [("twice", "t.pdf", 1, huge[:900]), ("twice", "t.pdf", 1, "Another first page."), ("blank", "b.pdf", 1, " " * 5000)]
    pages = spark.createDataFrame(rows, "document_id string, filename string, page_number int, text string").cache()
    plain = EngineConfig(chunk_size=40, chunk_overlap=10)
    cut = EngineConfig(chunk_size=40, chunk_overlap=10, long_document_characters=500, folio_words=100, folios_per_span=7)
    got = actual_chunks(chunk_documents(pages, cut))
    assert got == actual_chunks(chunk_documents(pages, plain))
    once = pages.filter("document_id <> 'twice'")
    expected = expected_chunks(spark, once, 40, 10)
    assert {k: v for k, v in got.items() if k[0] != "twice"} == expected


def test_pages_meet_the_numbers_of_their_chunks_once(spark, monkeypatch):
    monkeypatch.setattr(long_documents, "WORD_BUCKET", 16)
    monkeypatch.setattr(long_documents, "ASKED_AT_ONCE", 4)
    rng = random.Random(6)
    places, spans = [], []
    for document in ("a", "b"):
        start = 0
        for page in range(1, 30):
            words = rng.choice([0, 1, 5, 40, 200])
            places.append((document, page, start, words))
            start += words
        b = 0
        while b < start:
            e = min(start, b + rng.randint(1, 60))
            spans.append((document, len(spans) + 1, b, e))
            b = e
    told = spark.createDataFrame([("a", "a.pdf", 29), ("b", "b.pdf", 29)], "document_id string, filename string, document_page_count int")
    asked = long_documents._asked_of_pages(
        spark.createDataFrame(places, "document_id string, page_number int, page_start long, words long"),
        told,
        spark.createDataFrame(spans, "document_id string, sequence int, b long, e long"),
        7,
    ).collect()
    got = sorted((r.document_id, r.page_number, a.sequence) for r in asked for a in r.asked)
    assert got == sorted(
        (d, page, n)
        for d, page, start, words in places
        for other, n, b, e in spans
        if d == other and words and start < e and start + words > max(b - 7, 0)
    )
    assert all(len(r.asked) <= 4 and r.filename == f"{r.document_id}.pdf" for r in asked)


def test_folios_begin_inside_a_page(spark):
    words = " ".join(f"Sentence {i} of one page." for i in range(3000))
    pages = spark.createDataFrame([("d", "d.pdf", 1, words)], "document_id string, filename string, page_number int, text string")
    cfg = EngineConfig(chunk_size=50, chunk_overlap=5, folio_words=500)
    cut = long_documents._pages_with_units(pages, cfg)
    folios = long_documents._folios(cut, long_documents._page_starts(cut, cfg), cfg).orderBy("folio").collect()
    assert len(folios) == 30 and all(sum(f.ns) == 500 and f.start == 500 * f.folio for f in folios)


def test_documented_invariants(spark):
    sentence = " ".join
    one = sentence(f"This is sentence number {i} about the topic." for i in range(40))
    three = sentence(f"This is sentence number {i} about the topic." for i in range(20))
    pages = spark.createDataFrame(
        [("fp", "a.pdf", 1, one), ("fp", "a.pdf", 2, ""), ("fp", "a.pdf", 3, three)],
        "document_id string, filename string, page_number int, text string",
    )
    cfg = EngineConfig(chunk_size=60, chunk_overlap=10)
    rows = chunk_documents(pages, cfg).orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(1, len(rows) + 1))
    assert all(r.document_page_count == 3 and r.word_count <= 70 for r in rows)
    assert all(r.chunk_id.startswith("chunk_") and len(r.chunk_id) == 38 for r in rows)
    again = chunk_documents(pages.repartition(3), cfg).orderBy("sequence").collect()
    assert [r.chunk_id for r in rows] == [r.chunk_id for r in again]


def test_documents_without_text_or_name_yield_no_chunk(spark):
    pages = spark.createDataFrame(
        [("a", "a.pdf", 1, " \n "), ("", "b.pdf", 1, "Some text."), ("c", "  ", 1, "Some text.")],
        "document_id string, filename string, page_number int, text string",
    )
    assert chunk_documents(pages, EngineConfig()).count() == 0


def test_short_document_plan_has_one_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"),
        F.lit("d.pdf").alias("filename"),
        F.lit(1).alias("page_number"),
        "text",
    )
    plan = chunk_documents(pages, EngineConfig())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "lang" not in plan


def test_exit_tables_agree_with_the_fold():
    rng = random.Random(4)
    for _ in range(300):
        target = rng.choice([1, 5, 12, 60])
        overlap, start = rng.randint(0, target - 1), rng.choice([0, 3, 59, 1000])
        ns = np.array([rng.randint(1, target + 2) for _ in range(rng.randint(0, 30))], dtype=np.int64)
        sections = np.array([rng.random() < 0.1 for _ in ns], dtype=bool)
        expected = [
            flush_points(ns.tolist(), sections.tolist(), start, min(s, start), target, overlap)[1] for s in range(target)
        ]
        assert long_documents.exit_table(ns, sections, start, target, overlap).tolist() == expected


def test_spans_and_entries_are_carried_over_batches():
    """Groups stream by, and one may begin in one batch and end in the next."""
    folios = pd.DataFrame(
        [("a", 0, 0, [1, 2, 0]), ("a", 0, 1, [2, 0, 1]), ("a", 1, 2, [0, 0, 0]), ("b", 0, 0, [2, 2, 2])],
        columns=["document_id", "span", "folio", "exits"],
    )
    for cut in range(5):
        batches = [folios[:cut], folios[cut:]]
        spans = pd.concat(long_documents._compose(3)(iter(batches)))
        told = [(r.document_id, r.span, list(r.exits)) for r in spans.itertuples()]
        assert told == [("a", 0, [0, 1, 2]), ("a", 1, [0, 0, 0]), ("b", 0, [2, 2, 2])]
        entered = [b.assign(entry=[1, 1, 2, 0][b.index.start : b.index.stop]) for b in batches]
        found = pd.concat(long_documents._follow(["document_id", "span"], "folio", "entry", "since")(iter(entered)))
        assert found["since"].tolist() == [1, 2, 2, 0]
