import difflib

import pytest
from pyspark.sql import functions as F

from pagewright.functions import prompts
from pagewright.functions.routing import VOCABULARY, normalize_question, repair_word
from pagewright.operators.routing import route_questions

GOLDEN = [
    ("What is this document about?", True),
    ("summarize", True),
    ("Summarize this pdf in 3 bullets", True),
    ("waht is thsi doc abuot", True),
    ("how many pages?", True),
    ("Who wrote this paper?", True),
    ("What are the main points of this document?", True),
    ("What are the main points of chapter 2?", False),
    ("explain the methodology section", False),
    ("What does the document say about revenue growth in 2023?", False),
    ("What is the capital of France?", False),
    ("summarise the introduction", False),
    ("what is the interest rate on the loan agreement", False),
    ("hello", False),
]
MORE = [
    (None, False),
    ("  \n", False),
    ("summarize " + "x" * 400, False),
    ("list the sections of this report", True),
    ("list the sections of chapter 4", False),
    ("give me a quick overview", True),
    ("could you explain this paper", True),
    ("explain the paper's results on page 3", False),
    ("**TL;DR**", True),
    ("ＳＵＭＭＡＲＩＺＥ", True),
    ("who is the author", True),
    ("key findings about inflation", False),
]


def test_golden_routes(spark):
    cases = GOLDEN + MORE
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "question_id long, question string")
    got = {r.question_id: r.document_level for r in route_questions(df).collect()}
    assert [(q, got[i]) for i, (q, _) in enumerate(cases)] == cases


def test_question_normalization(spark):
    cases = {
        "  What’s `THIS`  #doc# abt ": "what's 'this' document about",
        "sumarize teh docments pls": "summarize teh documents please",
        "overvew of structre": "overview of structure",
        "document documents reported": "document documents reported",
        "u r tldr": "you r tl;dr",
        "": "",
    }
    df = spark.createDataFrame([(q,) for q in cases], "question string")
    got = {r.question: r.n for r in df.select("question", normalize_question(F.col("question")).alias("n")).collect()}
    assert got == cases


def _common(a, b):
    """Matching characters by repeatedly taking the longest common run, leftmost first."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n + _common(a[:i], b[:j]) + _common(a[i + n :], b[j + n :]) if n else 0


@pytest.mark.parametrize("word", ["docment", "sumaries", "ovrview", "contnets", "artcle", "purposes", "banana"])
def test_repair_uses_the_gestalt_ratio(word):
    scores = {v: 2 * _common(v, word) / (len(v) + len(word)) for v in VOCABULARY}
    for v, score in scores.items():
        assert difflib.SequenceMatcher(None, v, word).ratio() == score
    best = max(VOCABULARY, key=lambda v: (scores[v], v))
    close = scores[best] >= 0.84 and not best.startswith(word) and not word.startswith(best)
    assert repair_word(word) == (best if close else word)


def test_prompts(spark):
    df = spark.createDataFrame([("Why?\nReally?", "EVIDENCE")], "q string, e string")
    row = df.select(
        prompts.grounded_user(F.col("q"), F.col("e")).alias("g"),
        prompts.overview_user(F.col("q"), F.col("e")).alias("o"),
        prompts.overview_system(F.lit(True)).alias("s"),
        prompts.echo_answer(prompts.grounded_user(F.col("q"), F.col("e"))).alias("a"),
        prompts.is_abstention(F.lit("\n insufficient_evidence.")).alias("x"),
    ).first()
    assert row.g.startswith("<user_question>\nWhy?\nReally?\n</user_question>\n\n<document_evidence>\nThe following")
    assert row.g.endswith("EVIDENCE\n</document_evidence>\n\nAnswer the user question using only the evidence above.")
    assert row.o.endswith("only the document profile and excerpts above.")
    assert row.s.endswith("INSUFFICIENT_EVIDENCE\n   and nothing else.")
    assert row.a == "FAKE-ANSWER for: Why?" and row.x
