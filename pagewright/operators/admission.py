"""Validation. Each validator is one ordered CASE whose first failing test gives the error;
rows are then split into accepted and rejected. A bad row never fails a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions import text as tx

# Accepted content types, the signature and where it may start, error codes.
ALLOWED_CONTENT_TYPES = [
    "application/pdf",
    "application/x-pdf",
    "application/acrobat",
    "application/octet-stream",
]
SIGNATURE = b"%PDF-"
SIGNATURE_WINDOW = 1024
STATUS_OF = {
    "MISSING_FILE": 400,
    "EMPTY_FILE": 400,
    "FILE_TOO_LARGE": 413,
    "MISSING_FILENAME": 400,
    "INVALID_FILENAME": 400,
    "INVALID_CONTENT_TYPE": 400,
    "INVALID_PDF_SIGNATURE": 400,
    "PDF_ENCRYPTED": 422,
    "CORRUPTED_PDF": 400,
    "PAGE_EXTRACTION_FAILED": 422,
    "PDF_EXTRACTION_FAILED": 422,
    "NO_EXTRACTABLE_TEXT": 422,
    "NO_CHUNKS_CREATED": 422,
    "MISSING_DOCUMENT_FINGERPRINT": 500,
    "VALIDATION_ERROR": 422,
    "QUESTION_REQUIRED": 400,
    "EMPTY_QUESTION": 400,
    "QUESTION_TOO_LONG": 413,
    "NO_DOCUMENTS_INDEXED": 409,
}


def _status(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    return F.try_element_at(table, code)


def first_failing(tests: list[tuple[Column, str]]) -> Column:
    """The code of the first test that holds, null if none does."""
    return F.coalesce(*[F.when(test, F.lit(code)) for test, code in tests])


def split_by_error(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    extra = [c for c in ("error_code", "error_status", "error_details") if c in checked.columns]
    return (
        checked.filter(F.col("error_code").isNull()).drop(*extra),
        checked.filter(F.col("error_code").isNotNull()),
    )


# --- files -------------------------------------------------------------------


def bare_content_type(c: Column) -> Column:
    """Lower-case type without parameters; null where none was declared."""
    declared = F.lower(tx.strip(c))
    return F.when(declared != "", tx.strip(F.substring_index(declared, ";", 1)))


def file_errors(files: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Add ``clean_filename``, ``bare_type`` and the error columns to uploaded files.

    ``files`` has ``filename``, ``content_type``, ``content`` and optionally ``length``
    (which spares reading oversized content) and ``parser_status``, the verdict of the
    upstream parser.
    """
    size = F.octet_length("content")
    if "length" in files.columns:
        size = F.coalesce("length", size)
    clean = tx.base_filename(F.col("filename"))
    bare = bare_content_type(F.col("content_type"))
    head = F.substring("content", 1, SIGNATURE_WINDOW)
    code = (
        F.when(size.isNull(), F.lit("MISSING_FILE"))
        .when(size == 0, F.lit("EMPTY_FILE"))
        .when(size > cfg.max_upload_size_bytes, F.lit("FILE_TOO_LARGE"))
        .when(F.col("content").isNull(), F.lit("MISSING_FILE"))
        .when(F.coalesce(clean, F.lit("")) == "", F.lit("MISSING_FILENAME"))
        .when(~F.lower(clean).endswith(".pdf"), F.lit("INVALID_FILENAME"))
        .when(bare.isNotNull() & ~bare.isin(ALLOWED_CONTENT_TYPES), F.lit("INVALID_CONTENT_TYPE"))
        .when(~F.contains(head, F.lit(SIGNATURE)), F.lit("INVALID_PDF_SIGNATURE"))
    )
    if "parser_status" in files.columns:
        code = code.when(F.col("parser_status").isin("PDF_ENCRYPTED", "CORRUPTED_PDF"), F.col("parser_status"))
    details = F.when(
        F.col("error_code") == "FILE_TOO_LARGE",
        F.create_map(
            F.lit("size_bytes"),
            size.cast("string"),
            F.lit("max_size_bytes"),
            F.lit(str(cfg.max_upload_size_bytes)),
        ),
    ).when(
        F.col("error_code") == "INVALID_CONTENT_TYPE",
        F.create_map(F.lit("content_type"), F.lower(tx.strip(F.col("content_type")))),
    )
    return (
        files.withColumn("clean_filename", clean)
        .withColumn("bare_type", bare)
        .withColumn("error_code", code)
        .withColumn("error_status", _status(F.col("error_code")))
        .withColumn("error_details", details)
    )


def admit_files(files: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    return split_by_error(file_errors(files, cfg))


# --- documents ---------------------------------------------------------------


def has_meaning(c: Column) -> Column:
    """Whether anything is left of a text after normalization: some character is neither
    deleted as a control character nor whitespace. Stops at the first one."""
    return F.coalesce(c, F.lit("")).rlike(r"[^\p{javaWhitespace}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def document_gate(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per document: page counts and the error that keeps it from being chunked."""
    keys = keys or ["document_id"]
    carried = [c for c in ("document_id", "filename") if c not in keys]
    stats = pages.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in carried],
        F.count("*").alias("page_count"),
        F.count_if(tx.is_blank(F.coalesce("text", F.lit("")))).alias("empty_page_count"),
        F.bool_or(has_meaning(F.col("text"))).alias("meaningful"),
    )
    code = (
        F.when(~F.col("meaningful"), F.lit("NO_EXTRACTABLE_TEXT"))
        .when(F.coalesce("document_id", F.lit("")) == "", F.lit("MISSING_DOCUMENT_FINGERPRINT"))
        .when(tx.is_blank(F.coalesce("filename", F.lit(""))), F.lit("MISSING_FILENAME"))
    )
    return (
        stats.withColumn("error_code", code)
        .withColumn(
            "error_status",
            # Inside the engine a missing name is a fault of the caller's plan, not of a client.
            F.when(F.col("error_code") == "MISSING_FILENAME", F.lit(500)).otherwise(_status(F.col("error_code"))),
        )
        .withColumn(
            "error_details",
            F.when(
                F.col("error_code") == "NO_EXTRACTABLE_TEXT",
                F.create_map(F.lit("page_count"), F.col("page_count").cast("string")),
            ),
        )
    )


def gate_documents(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by_error(document_gate(pages))


def without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Accepted documents that yielded no chunk."""
    made = chunks.select(F.col("document_fingerprint").alias("document_id")).distinct()
    return documents.join(made, "document_id", "left_anti").withColumn(
        "error_code", F.lit("NO_CHUNKS_CREATED")
    ).withColumn("error_status", F.lit(422))


# --- questions ---------------------------------------------------------------


def question_errors(
    questions: DataFrame, chunks: DataFrame | None, cfg: EngineConfig, request_level: bool = True
) -> DataFrame:
    """Add ``cleaned`` and the error columns to ``(question_id, question)``.

    With ``request_level`` the stricter tests on the raw request come first; an optional
    ``question_type`` then tells a missing question and one that is no string apart.
    ``chunks`` stands for the store; pass None where it is known to hold documents.
    """
    raw = F.col("question")
    cleaned = tx.strip(raw)
    limit = cfg.max_question_length
    tests, kind = [], None
    if request_level:
        typed = F.col("question_type") if "question_type" in questions.columns else F.lit("string")
        kind = (
            F.when((typed == "missing") | ((typed == "string") & raw.isNull()), F.lit("missing"))
            .when(typed != "string", F.lit("string_type"))
            .when(raw == "", F.lit("string_too_short"))
            .when(tx.utf16_length(raw) > limit, F.lit("string_too_long"))
        )
        tests.append((kind.isNotNull(), "VALIDATION_ERROR"))
    tests += [
        (raw.isNull(), "QUESTION_REQUIRED"),
        (cleaned == "", "EMPTY_QUESTION"),
        (tx.utf16_length(cleaned) > limit, "QUESTION_TOO_LONG"),
    ]
    checked = questions
    if chunks is not None:
        # At most one row, so that the broadcast has a fixed size.
        probe = chunks.select(F.lit(True).alias("_indexed")).limit(1).withColumn("_one", F.lit(1))
        checked = (
            questions.withColumn("_one", F.lit(1)).join(F.broadcast(probe), "_one", "left").drop("_one")
        )
        tests.append((F.col("_indexed").isNull(), "NO_DOCUMENTS_INDEXED"))
    details = F.when(
        F.col("error_code") == "QUESTION_TOO_LONG", F.create_map(F.lit("max_length"), F.lit(str(limit)))
    )
    if kind is not None:
        details = details.when(
            F.col("error_code") == "VALIDATION_ERROR", F.create_map(F.lit("type"), kind)
        )
    return (
        checked.withColumn("cleaned", cleaned)
        .withColumn("error_code", first_failing(tests))
        .withColumn("error_status", _status(F.col("error_code")))
        .withColumn("error_details", details)
        .drop("_indexed")
    )


def validate_questions(
    questions: DataFrame, chunks: DataFrame | None, cfg: EngineConfig, request_level: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Accepted questions, stripped, and rejected ones with their error."""
    good, bad = split_by_error(question_errors(questions, chunks, cfg, request_level))
    return good.withColumn("question", F.col("cleaned")).drop("cleaned"), bad.drop("cleaned")


# --- error triage --------------------------------------------------------------

# Families of error codes.
FILE_CODES = [
    "FILE_TOO_LARGE",
    "INVALID_FILENAME",
    "INVALID_CONTENT_TYPE",
    "INVALID_PDF_SIGNATURE",
    "EMPTY_FILE",
]
EXTRACTION_CODES = [
    "PAGE_EXTRACTION_FAILED",
    "PDF_EXTRACTION_FAILED",
    "NO_EXTRACTABLE_TEXT",
    "PDF_ENCRYPTED",
    "CORRUPTED_PDF",
]
RATE_CODES = ["GENERATION_RATE_LIMIT", "EMBEDDING_RATE_LIMIT"]
MESSAGES = {
    "waking": "The backend is waking up or restarting. Wait about a minute and try again.",
    "large": "The selected PDF is too large for the server.",
    "silent": "The backend did not respond. The server may be waking up or CORS_ALLOWED_ORIGINS "
    "may not include this site. Try again in a minute.",
    "file-validation": "The selected PDF is not valid for this application.",
    "document-extraction": "The PDF could not be converted into usable text.",
    "rate-limited": "The AI provider rate limit was reached. Try again shortly.",
    "document-ingestion": "The document could not be indexed successfully.",
    "retrieval-unavailable": "Document retrieval is currently unavailable.",
    "generation-unavailable": "Answer generation is currently unavailable.",
    "unknown": "The request failed. Please try again.",
}


def triage(errors: DataFrame) -> DataFrame:
    """Add ``category``, ``shown_code``, ``shown_message`` and ``retryable`` to errors.

    ``errors`` has ``error_code`` and ``http_status``, either possibly null, and optionally
    ``error_name`` and ``error_message``.
    """
    code = F.coalesce("error_code", F.lit("NETWORK_ERROR"))
    status = F.col("http_status")
    name = F.col("error_name") if "error_name" in errors.columns else F.lit(None).cast("string")
    said = F.col("error_message") if "error_message" in errors.columns else F.lit("")
    said = tx.strip(F.coalesce(said, F.lit("")))

    gateway = F.col("error_code").isNull() & status.isin(502, 503, 504)
    too_large = status == 413
    silent = (name == "TimeoutError") | (status == 0)
    family = (
        F.when(code.isin(FILE_CODES), F.lit("file-validation"))
        .when(code.isin(EXTRACTION_CODES), F.lit("document-extraction"))
        .when(code.isin(RATE_CODES), F.lit("rate-limited"))
        .when(
            code.startswith("EMBEDDING_")
            | code.isin("NO_CHUNKS_CREATED", "INDEXING_FAILED")
            | code.startswith("INDEX_"),
            F.lit("document-ingestion"),
        )
        .when(
            code.isin("NO_DOCUMENTS_INDEXED", "INVALID_RETRIEVAL_DISTANCE") | code.startswith("RETRIEVAL_"),
            F.lit("retrieval-unavailable"),
        )
        .when(code.startswith("GENERATION_"), F.lit("generation-unavailable"))
        .otherwise(F.lit("unknown"))
    )
    texts = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    first = F.when(gateway, F.lit("waking")).when(too_large, F.lit("large")).when(silent, F.lit("silent"))
    return (
        errors.withColumn(
            "category",
            F.when(gateway, F.lit("backend-unavailable"))
            .when(too_large, F.lit("file-validation"))
            .when(silent, F.lit("backend-unavailable"))
            .otherwise(family),
        )
        .withColumn(
            "shown_code",
            F.when(gateway, F.concat(F.lit("HTTP_"), status.cast("string")))
            .when(too_large, F.lit("FILE_TOO_LARGE"))
            .otherwise(code),
        )
        .withColumn(
            "shown_message",
            F.when(first.isNotNull(), F.element_at(texts, first))
            .when(said != "", said)
            .otherwise(F.element_at(texts, family)),
        )
        .withColumn("retryable", ~F.col("category").isin("file-validation", "document-extraction"))
    )


def triage_summary(errors: DataFrame) -> DataFrame:
    return triage(errors).groupBy("category", "retryable").agg(F.count("*").alias("errors"))
