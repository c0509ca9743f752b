import random

from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions.ordered import rows_at_positions, running_totals
from pagewright.operators.context import build_context, retrieval_diagnostics
from pagewright.operators.evaluation import retrieval_quality, threshold_sweep
from pagewright.operators.overview import build_overview, even_positions, render_overview, trim_interior
from pagewright.schemas import CHUNK


def spaced(total, limit):
    """Even positions with both ends, dropping the most crowded one while there are too many."""
    if total <= limit:
        return list(range(total))
    picks = sorted({round(i * (total - 1) / (limit - 1)) for i in range(limit)} | {0, total - 1})
    while len(picks) > limit:
        picks.pop(min(range(1, len(picks) - 1), key=lambda i: picks[i + 1] - picks[i - 1]))
    return picks


def test_even_positions(spark):
    cases = [(t, k) for t in [1, 2, 3, 4, 5, 9, 10, 11, 12, 25, 100, 1001] for k in (3, 4, 7, 10)]
    df = spark.createDataFrame(cases, "total int, k int")
    got = {(r.total, r.k): r.p for r in df.select("total", "k", even_positions(F.col("total"), F.col("k")).alias("p")).collect()}
    assert got == {c: spaced(*c) for c in cases}


def test_trimming(spark):
    rng = random.Random(2)
    cases = [[rng.randint(1, 300) for _ in range(rng.randint(1, 10))] for _ in range(60)]
    df = spark.createDataFrame(
        [(i, [(p, t) for p, t in enumerate(c)]) for i, c in enumerate(cases)], "id int, e array<struct<position:int,tokens:int>>"
    )
    got = {r.id: [e.tokens for e in r.t] for r in df.select("id", trim_interior(F.col("e"), F.lit(400), 10).alias("t")).collect()}
    for i, tokens in enumerate(cases):
        kept = list(tokens)
        while len(kept) > 2 and sum(kept) > 400:
            kept.pop(len(kept) // 2)
        assert got[i] == kept


def test_running_totals_and_ranks(spark):
    rng = random.Random(4)
    rows = [(f"k{k}", p, rng.randint(0, 9)) for k in range(3) for p in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r.k, r.p): r.before for r in running_totals(df, ["k"], "p", {"v": "before"}, 16).collect()}
    assert got == {(k, p): sum(v for k2, p2, v in rows if k2 == k and p2 < p) for k, p, _ in rows}
    wanted = spark.createDataFrame([("k0", 0), ("k0", 57), ("k1", 119), ("k2", 500)], "k string, position int")
    picked = {(r.k, r.position): r.p for r in rows_at_positions(df, ["k"], "p", wanted, 16).collect()}
    order = {k: sorted(p for k2, p, _ in rows if k2 == k) for k in ("k0", "k1", "k2")}
    assert picked == {("k0", 0): order["k0"][0], ("k0", 57): order["k0"][57], ("k1", 119): order["k1"][119]}


def chunk(doc, name, seq, text, pages=(1, 1), total=3):
    return (f"{doc}-{seq}", doc, name, text, pages[0], pages[1], seq, len(text.split()), ["sentence"], total)


def test_overview_of_many_documents(spark):
    rows = [chunk(f"d{d}", f"{'B' if d % 2 else 'a'}{d}.pdf", s, f"word {d} {s} " * 100) for d in range(7) for s in range(1, 13)]
    rows.append(chunk("e", "AA.pdf", 1, "Only one.", (0, 0), 0))
    cfg = EngineConfig(overview_excerpt_words=20)
    built = build_overview(spark.createDataFrame(rows, CHUNK), cfg).orderBy("doc_index").collect()
    assert [r.filename for r in built] == ["a0.pdf", "a2.pdf", "a4.pdf", "a6.pdf", "AA.pdf"]
    assert [e.position for e in built[0].excerpts] == spaced(12, 4)
    assert len(built[0].excerpts[0].text.split()) == 41 and len(built[0].excerpts[1].text.split()) == 21
    assert built[0].token_budget == 800 and built[0].total_documents == 8
    row = render_overview(build_overview(spark.createDataFrame(rows, CHUNK), cfg)).first()
    assert row.rendered.startswith(
        "<document_profile>\nindexed_documents_total: 8\ndocuments_shown_below: 5 (the rest are omitted for length)\n"
        "document 1: filename=a0.pdf | total_pages=3 | indexed_sections=12 | excerpts_shown=4\n"
    )
    assert "filename=AA.pdf | total_pages=unknown | indexed_sections=1" in row.rendered
    assert row.rendered.endswith(
        "[EXCERPT document 5: AA.pdf]\npages: 0-0\nposition: section 1 of 1\n<document_chunk>\nOnly one.\n</document_chunk>"
    )
    assert [s["rank"] for s in row.sources] == list(range(1, 18))
    assert render_overview(build_overview(spark.createDataFrame([], CHUNK), cfg)).count() == 0


CANDIDATE = (
    "question_id long, rank int, source_id string, filename string, chunk_id string, start_page int, "
    "end_page int, sequence int, distance double, text string"
)


def test_context_skips_what_does_not_fit(spark):
    rows = [
        (1, 1, "d:a", "z.pdf", "a", 2, 3, 4, 0.1, "x" * 40),
        (1, 2, "d:b", "a.pdf", "b", 1, 1, 1, 0.2, "y" * 400),
        (1, 3, "d:c", "a.pdf", "c", 1, 1, 2, 0.30000049, "z" * 38),
        (2, 1, "d:b", "a.pdf", "b", 1, 1, 1, 0.2, "y" * 400),
    ]
    got = {r.question_id: r for r in build_context(spark.createDataFrame(rows, CANDIDATE), 20).collect()}
    one = got[1]
    assert [b.chunk_id for b in one.blocks] == ["c", "a"] and [s["rank"] for s in one.sources] == [1, 3]
    assert one.estimated_tokens == 20 and one.accepted_count == 3
    assert one.rendered == (
        "[SOURCE 1]\nsource_id: d:c\nfilename: a.pdf\npages: 1-1\nchunk_id: c\nsequence: 2\ndistance: 0.300000\n"
        "text:\n<document_chunk>\n" + "z" * 38 + "\n</document_chunk>\n\n[SOURCE 2]\nsource_id: d:a\nfilename: z.pdf\n"
        "pages: 2-3\nchunk_id: a\nsequence: 4\ndistance: 0.100000\ntext:\n<document_chunk>\n" + "x" * 40 + "\n</document_chunk>"
    )
    assert got[2].blocks == [] and got[2].accepted_count == 1


def test_diagnostics_and_evaluation(spark):
    questions = spark.createDataFrame([(1, "abc"), (2, "nothing found")], "question_id long, question string")
    found = spark.createDataFrame(
        [(1, 1, 0.1234565, "a"), (1, 2, 0.9, "b")], "question_id long, rank int, distance double, chunk_id string"
    )
    rows = {r.question_id: r for r in retrieval_diagnostics(questions, found, 0.7).collect()}
    assert rows[1].accepted_ranks == [1] and rows[1].accepted_chunk_ids == ["a"] and rows[1].candidate_count == 2
    assert rows[2].candidate_distances == [] and rows[2].accepted_count == 0 and rows[2].question_length == 13

    scored = spark.createDataFrame([(0.1, True), (0.3, False), (0.3, True), (0.9, False)], "distance double, relevant boolean")
    sweep = {r.threshold: (r.accepted, r.accepted_relevant) for r in threshold_sweep(scored, [0.3, 0.05, 0.2]).collect()}
    assert sweep == {0.05: (0, 0), 0.2: (1, 1), 0.3: (3, 2)}

    expected = spark.createDataFrame(
        [(1, "answerable", "a"), (2, "unanswerable", None)], "question_id long, scenario string, chunk_id string"
    )
    quality = {r.scenario: r for r in retrieval_quality(found, expected).collect()}
    assert (quality["answerable"].hits, quality["answerable"].precision_at_k) == (1, 0.5)
    assert (quality["unanswerable"].hits, quality["unanswerable"].hit_rate) == (1, 1.0)
