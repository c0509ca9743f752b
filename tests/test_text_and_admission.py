import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions import text as tx
from pagewright.operators.admission import (
    admit_files,
    document_gate,
    gate_documents,
    has_meaning,
    triage,
    validate_questions,
    without_chunks,
)
from pagewright.sources.files import scan_files

# Characters for which Java's isWhitespace holds.
JAVA_SPACE = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B))]
JAVA_SPACE += ["\u2028", "\u2029", "\u205f", "\u3000"]
STRIP = "".join(JAVA_SPACE)


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")


def apply(spark, values, fn):
    got = column(spark, values).select("id", fn(F.col("v")).alias("r")).collect()
    return [r for _, r in sorted((x.id, x.r) for x in got)]


NORMALIZED = [
    ("", ""),
    (None, ""),
    ("a\r\nb\rc", "a\nb\nc"),
    ("one\ttwo   three", "one two three"),
    ("  padded \n lines\t", "padded\nlines"),
    ("hyphen-\nated", "hyphenated"),
    ("a-\nb-\nc", "abc"),
    ("A-\nb", "A-\nb"),
    ("é-\nb", "é-\nb"),
    ("hy-\r\nphen", "hyphen"),
    ("bell\x07 and del\x7f", "bell and del"),
    ("a\x00-\n\x00b", "ab"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("a\n \t \n\x0b\n\nb", "a\n\nb"),
    ("\u00a0kept\u00a0", "\u00a0kept\u00a0"),
    ("\u3000gone\u2003", "gone"),
]


def test_normalization(spark):
    assert apply(spark, [v for v, _ in NORMALIZED], tx.normalize_text) == [r for _, r in NORMALIZED]
    rng = random.Random(11)
    alphabet = ["a", "b", "Z", "é", "-", "-\n", "\n", "\r", "\r\n", "\t", " ", "  ", "\x07", "\x1c", "\x7f", "\u00a0", "\u2003", "\u3000", "😀", "."]
    values = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)]
    found = apply(spark, values, tx.normalize_text)
    for value, text in zip(values, found):
        assert not re.search(r"[\x00-\x09\x0b-\x1f\x7f]|  |\n\n\n", text)
        assert all(line == line.strip(STRIP) for line in text.split("\n"))
        # Letters and other marks stay, in order.
        assert re.sub(r"[^abZé😀.]", "", text) == re.sub(r"[^abZé😀.]", "", value)
    assert apply(spark, values, has_meaning) == [text != "" for text in found]
    assert apply(spark, values, tx.strip) == [v.strip(STRIP) for v in values]


def test_single_spaced_sentences_agree_with_the_general_form(spark):
    rng = random.Random(5)
    pieces = ["One.", "Two!", "three", "“Four?”", "Été.", "5", "(Six).", "A", "b.", "'Q'", "[R]", "?"]
    values = [" ".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(400)]
    assert apply(spark, values, lambda c: tx.sentences(c, True)) == apply(spark, values, tx.sentences)
    expected = [re.split("(?<=[.!?])\\s+(?=[\"“”'(\\[]?[A-Z0-9])", v, flags=re.ASCII) for v in values]
    assert apply(spark, values, tx.sentences) == expected


@pytest.mark.parametrize(
    "line,expected",
    [
        ("2.1 Scope and Terms", True),
        ("3) What now", True),
        ("1. Ends with a stop.", False),
        ("KEY FINDINGS", True),
        ("ÉTÉ 2020", True),
        ("Introduction and Overview", False),
        ("Introduction And Overview", True),
        ("Title", False),
        ("TITLE", True),
        ("One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen", False),
        ("2.1 " + "word " * 25, True),
        ("A" * 141, False),
        ("12345", False),
        ("", False),
        ("Really?", False),
    ],
)
def test_headings(spark, line, expected):
    assert apply(spark, [line], tx.is_section_heading) == [expected]


def test_lengths_count_utf16_units(spark):
    assert apply(spark, ["", "abcd", "abcde", "😀😀😀"], tx.estimate_tokens) == [1, 1, 2, 2]
    assert apply(spark, ["a b c", " a  b ", ""], lambda c: tx.truncate_words(c, F.lit(2))) == ["a b …", "a b", ""]


def test_file_admission(spark, tmp_path):
    pdf = bytearray(b"%PDF-1.7 x")
    cases = [
        (None, "a.pdf", None, "MISSING_FILE", 400),
        (bytearray(), "a.pdf", None, "EMPTY_FILE", 400),
        (pdf * 20, "a.pdf", None, "FILE_TOO_LARGE", 413),
        (pdf, None, None, "MISSING_FILENAME", 400),
        (pdf, "dir\\", None, "MISSING_FILENAME", 400),
        (pdf, "x.txt", "application/pdf", "INVALID_FILENAME", 400),
        (pdf, "x.pdf", "text/html", "INVALID_CONTENT_TYPE", 400),
        (pdf, "x.pdf", ";charset=x", "INVALID_CONTENT_TYPE", 400),
        (bytearray(b"nothing"), "x.pdf", None, "INVALID_PDF_SIGNATURE", 400),
        (pdf, " C:\\up\\X.PDF ", " Application/PDF ; q=1", None, None),
        (bytearray(b"junk %PDF-1.4"), "x.pdf", "", None, None),
    ]
    df = spark.createDataFrame(
        [(i, c, f, t) for i, (c, f, t, _, _) in enumerate(cases)],
        "id int, content binary, filename string, content_type string",
    )
    good, bad = admit_files(df, EngineConfig(max_upload_size_bytes=100))
    assert {r.id: (r.error_code, r.error_status) for r in bad.collect()} == {
        i: (c, s) for i, (_, _, _, c, s) in enumerate(cases) if c
    }
    assert {r.id: r.clean_filename for r in good.collect()} == {9: "X.PDF", 10: "x.pdf"}
    large = bad.filter("error_code = 'FILE_TOO_LARGE'").first().error_details
    assert large == {"size_bytes": "200", "max_size_bytes": "100"}

    (tmp_path / "small.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "large.pdf").write_bytes(b"%PDF-1.7" * 100)
    files = scan_files(spark, str(tmp_path), EngineConfig(max_upload_size_bytes=100))
    good, bad = admit_files(files, EngineConfig(max_upload_size_bytes=100))
    assert [r.filename for r in good.collect()] == ["small.pdf"]
    row = bad.first()
    assert (row.error_code, row.content, row.length) == ("FILE_TOO_LARGE", None, 800)


def test_parser_verdicts_come_last(spark):
    df = spark.createDataFrame(
        [(bytearray(b"%PDF-"), "a.pdf", None, "PDF_ENCRYPTED"), (bytearray(b"x"), "b.pdf", None, "CORRUPTED_PDF")],
        "content binary, filename string, content_type string, parser_status string",
    )
    _, bad = admit_files(df, EngineConfig())
    assert {r.filename: r.error_code for r in bad.collect()} == {"a.pdf": "PDF_ENCRYPTED", "b.pdf": "INVALID_PDF_SIGNATURE"}


def test_document_gate(spark):
    pages = spark.createDataFrame(
        [("a", "a.pdf", 1, "x"), ("a", "a.pdf", 2, " "), ("b", "b.pdf", 1, "\x07"), ("", "c.pdf", 1, "x"), ("d", " ", 1, "x")],
        "document_id string, filename string, page_number int, text string",
    )
    rows = {r.document_id: r for r in document_gate(pages).collect()}
    assert (rows["a"].page_count, rows["a"].empty_page_count, rows["a"].error_code) == (2, 1, None)
    assert (rows["b"].error_code, rows["b"].empty_page_count) == ("NO_EXTRACTABLE_TEXT", 0)
    assert rows["b"].error_details == {"page_count": "1"}
    assert rows[""].error_code == "MISSING_DOCUMENT_FINGERPRINT" and rows["d"].error_code == "MISSING_FILENAME"
    good, bad = gate_documents(pages)
    assert good.count() == 1 and bad.count() == 3
    none = spark.createDataFrame([], "document_fingerprint string")
    assert [r.error_code for r in without_chunks(good, none).collect()] == ["NO_CHUNKS_CREATED"]


def test_engine_level_question_checks(spark):
    df = spark.createDataFrame(
        [(1, None), (2, " "), (3, "x" * 12), (4, " ok ")], "question_id long, question string"
    )
    good, bad = validate_questions(df, None, EngineConfig(max_question_length=10), request_level=False)
    assert {r.question_id: (r.error_code, r.error_status) for r in bad.collect()} == {
        1: ("QUESTION_REQUIRED", 400),
        2: ("EMPTY_QUESTION", 400),
        3: ("QUESTION_TOO_LONG", 413),
    }
    assert [r.question for r in good.collect()] == ["ok"]


def test_triage(spark):
    cases = [
        (None, 503, "backend-unavailable", "HTTP_503", True),
        ("INDEX_COUNT_MISMATCH", 502, "document-ingestion", "INDEX_COUNT_MISMATCH", True),
        ("QUESTION_TOO_LONG", 413, "file-validation", "FILE_TOO_LARGE", False),
        (None, 0, "backend-unavailable", "NETWORK_ERROR", True),
        ("EMBEDDING_RATE_LIMIT", 429, "rate-limited", "EMBEDDING_RATE_LIMIT", True),
        ("NO_DOCUMENTS_INDEXED", 409, "retrieval-unavailable", "NO_DOCUMENTS_INDEXED", True),
        ("GENERATION_FAILED", 502, "generation-unavailable", "GENERATION_FAILED", True),
        ("CORRUPTED_PDF", 400, "document-extraction", "CORRUPTED_PDF", False),
        (None, None, "unknown", "NETWORK_ERROR", True),
    ]
    df = spark.createDataFrame([(i, c, s) for i, (c, s, *_) in enumerate(cases)], "id int, error_code string, http_status int")
    got = {r.id: (r.category, r.shown_code, r.retryable) for r in triage(df).collect()}
    assert got == {i: tuple(rest) for i, (_, _, *rest) in enumerate(cases)}


@pytest.mark.parametrize(
    "wrong",
    [
        {"chunk_size": 0},
        {"chunk_overlap": -1},
        {"chunk_size": 50, "chunk_overlap": 50},
        {"top_k": 0},
        {"relevance_threshold": 0.0},
        {"relevance_threshold": 2.1},
        {"metric": "dot"},
        {"max_question_length": 0},
    ],
)
def test_configuration_is_checked(wrong):
    with pytest.raises(ValueError):
        EngineConfig(**wrong)


def test_normalized_lines_need_no_stripping(spark):
    raw = ["a \n  b　\n \n\n\nc  d\t\te", " \n", "", "x.\n   Y-\nz", "\n" * 50_000 + "A" + " " * 50_000 + "\n b"]
    found = apply(spark, raw, lambda c: tx.normalized_lines(tx.normalize_text(c)))
    assert found == [["a", "b", "c d e"], [], [], ["x.", "Y-", "z"], ["A", "b"]]
    assert found == apply(spark, raw, lambda c: tx.lines(tx.normalize_text(c)))


@pytest.mark.parametrize("line", ["é" * 140, "😀" * 70, "A" * 141, "😀" * 71, "1. " + "é" * 138])
def test_heading_length_counts_utf16_units(spark, line):
    short = len(line.encode("utf-16-le")) // 2 <= 140
    expected = short and (line.upper() == line and any(c.isalpha() for c in line) or line.startswith("1."))
    assert apply(spark, [line], lambda c: tx.is_section_heading(c, stripped=True)) == [expected]
