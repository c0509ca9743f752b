import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm.fill_middle import FillMiddle, cuts_of, fill_in_middle, restored_text


def brute(doc_id, text, percent=100, spm=50, seed=7):
    """The contract, line by line."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(lines)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("a\né漢😀\x8a\n", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=6), st.integers(0, 2))
def test_word_marks_find_the_lines(rows, skipped):
    import numpy as np

    column = pa.array([r[0] for r in rows], pa.string()).slice(min(skipped, len(rows)))
    rows = rows[skipped:]
    one, two = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    n, edges, chars, data = cuts_of(column, one, two)
    joined = data.tobytes()
    for i, (text, a, b) in enumerate(rows):
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        low, high = sorted((a % (len(lines) + 1), b % (len(lines) + 1)))
        assert n[i] == len(lines)
        parts = [joined[edges[j][i] : edges[j + 1][i]].decode() for j in range(3)]
        assert parts == ["".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])]
        assert [chars[j + 1][i] - chars[j][i] for j in range(3)] == [len(p) for p in parts]


TEXTS = [None, "", "\n", "one line", "a\nb\nc\n", "no end\nhere", "holds <S> it\nx", "é\n漢字\n😀 x\n\n\ny", "\n\n\n", "a<\nS>\n<\nP>", "w\n" * 20000 + "x" * 70000]


@pytest.mark.parametrize("cfg", [FillMiddle(), FillMiddle(seed=11, percent=60, spm=20)])
def test_equals_brute_force_and_restores(spark, cfg):
    rows = [(i % 90 if i != 3 else None, TEXTS[i % len(TEXTS)]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.select("*", F.lit("mine").alias("output"), F.lit(1).alias("h1"), F.lit("f").alias("form"))
    made = fill_in_middle(docs, cfg).withColumn("back", restored_text(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in made))) == sorted(str(brute(*r, cfg.percent, cfg.spm, cfg.seed)) for r in rows)
    assert sorted(r.back for r in made) == sorted(t or "" for _, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
