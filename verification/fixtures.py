"""Inputs of the registered queries, derived from the driver's tables.

Everything grows with the tables: no fixture picks out, samples or truncates rows or texts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions.text import fingerprint
from pagewright.operators.chunking import chunk_documents
from pagewright.operators.embedding import Embedder, embed, hash_embedder
from pagewright.session import materialize, spread

CFG = EngineConfig(
    chunk_size=120,
    chunk_overlap=20,
    relevance_threshold=0.30,
    max_context_tokens=700,
    overview_excerpt_words=40,
)
# A budget smaller than some chunks, so that nothing may fit.
NO_FALLBACK = replace(CFG, max_context_tokens=180, enable_overview_fallback=False)
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2]

# Question templates with their known route; "%s" stands for a turn's text.
TEMPLATES = [
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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _filename(number: str):
    return F.concat(F.lit("doc_"), F.lpad(F.col(number).cast("string"), 12, "0"), F.lit(".pdf"))


def decorated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-page documents with headings, empty pages, control characters, hyphenation,
    tabs, repeated spaces and CRLF. The document id stands for a hash of the file's bytes."""
    text = F.col("text")
    for old, new in [
        (".\n", ".\r\n\n\n\nKEY FINDINGS\n"),
        ("tion ", "ti-\non "),
        (" the ", "\tthe   "),
        (", ", ",\a "),
    ]:
        text = F.replace(text, F.lit(old), F.lit(new))
    heading = F.when(F.col("doc_id") % 3 == 0, F.lit("2.1 Scope and Terms\n")).otherwise(F.lit(""))
    pages = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 5).cast("long").alias("doc_no"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("page_number"),
        F.when(F.col("doc_id") % 7 == 6, F.lit("")).otherwise(F.concat(heading, text)).alias("text"),
    )
    digest = F.struct("page_number", fingerprint(F.col("text")).alias("sha"))
    ids = pages.groupBy("doc_no").agg(F.array_sort(F.collect_list(digest)).alias("d")).select(
        "doc_no", F.sha2(F.array_join(F.col("d.sha"), "|"), 256).alias("document_id")
    )
    pages = pages.join(ids, "doc_no").select(
        F.col("doc_no").alias("upload_id"), "document_id", _filename("doc_no").alias("filename"), "page_number", "text"
    )
    # The page table an extractor would have left behind.
    return spread(materialize(pages, "pages"))


def single_page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as a one-page upload; equal texts are equal documents."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("upload_id"),
        fingerprint(F.col("text")).alias("document_id"),
        _filename("doc_id").alias("filename"),
        F.lit(1).alias("page_number"),
        "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(decorated_pages(spark, sf_dir), CFG)


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(chunks(spark, sf_dir), "text", hash_embedder())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunks. ``question_id`` lets every vector also be a question."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("question_id"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("d"), (F.col("vec_id") % 20).cast("string")).alias("document_fingerprint"),
        (F.floor(F.col("vec_id") / 20) + 1).cast("int").alias("sequence"),
        "embedding",
        "label",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages, all conversation turns, and a template per turn."""
    turn = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    conversations = table(spark, sf_dir, "conversations")
    templates = F.array(*[F.lit(t) for t, _ in TEMPLATES])
    routes = F.array(*[F.lit(r) for _, r in TEMPLATES])
    pick = ((F.col("conv_id") * 7 + F.col("turn")) % len(TEMPLATES)).cast("int")
    return (
        table(spark, sf_dir, "benchmark")
        .select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit(False).alias("expected"))
        .unionByName(
            conversations.select(
                (turn + 1_000_000_000).alias("question_id"), F.col("text").alias("question"), F.lit(False).alias("expected")
            )
        )
        .unionByName(
            conversations.select(
                (turn + 2_000_000_000).alias("question_id"),
                templates[pick].alias("question"),
                routes[pick].alias("expected"),
            )
        )
    )


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns, some damaged the way requests can be."""
    kind = (F.col("conv_id") * 3 + F.col("turn")) % 7
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("question_id"),
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, F.lit(""))
        .when(kind == 2, F.lit(" \n\t "))
        .when(kind == 3, F.concat(F.lit("  "), text, F.lit("\n")))
        .when(kind == 4, F.repeat(F.concat(text, F.lit("?")), F.floor(F.lit(10000) / F.length("text")).cast("int") + 1))
        .otherwise(text)
        .alias("question"),
    )


def uploaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per row of ``documents``, with the faults uploads can have."""
    kind = F.col("doc_id") % 13
    body = F.col("text")
    content = (
        F.when(kind == 0, F.lit(None).cast("binary"))
        .when(kind == 1, F.lit("").cast("binary"))
        .when(kind == 2, body.cast("binary"))
        .when(kind == 3, F.concat(F.repeat(F.lit("x"), 900), F.lit("%PDF-1.7 "), body).cast("binary"))
        .when(kind == 4, F.concat(F.repeat(F.lit("x"), 1030), F.lit("%PDF-1.7 "), body).cast("binary"))
        .when(kind == 5, F.concat(F.lit("%PDF-1.4 "), F.repeat(body, 12)).cast("binary"))
        .otherwise(F.concat(F.lit("%PDF-1.4\n"), body).cast("binary"))
    )
    number = F.col("doc_id").cast("string")
    filename = (
        F.when(kind == 6, F.lit("  "))
        .when(kind == 7, F.concat(F.lit(" C:\\in\\Report "), number, F.lit(".PDF ")))
        .when(kind == 8, F.concat(number, F.lit(".txt")))
        .when(kind == 9, F.concat(F.lit("folder/"), number, F.lit("/")))
        .otherwise(F.concat(F.lit("up/"), number, F.lit(".pdf")))
    )
    content_type = (
        F.when(kind == 10, F.lit("Application/PDF; charset=binary"))
        .when(kind == 11, F.lit("text/plain"))
        .when(kind == 12, F.lit(" application/octet-stream "))
        .when(kind == 7, F.lit(""))
        .otherwise(F.lit("application/pdf"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", filename.alias("filename"), content_type.alias("content_type"), content.alias("content")
    )


FILE_CFG = EngineConfig(max_upload_size_bytes=12_000)

UPLOAD_CFG = replace(CFG, max_upload_size_bytes=12_000)


def faulty_embed_texts(texts):
    """Fails by the lengths of its texts: the whole call, one vector too few, or a bad vector."""
    kinds = [len(t) % 11 for t in texts]
    if 0 in kinds:
        raise RuntimeError("no answer")
    if 1 in kinds:
        raise RuntimeError("EMBEDDING_TIMEOUT after 30 s")
    out = [[float(len(t)), float("nan") if k == 3 else 1.0] + [1.0] * (k == 4) for t, k in zip(texts, kinds)]
    return out[1:] if 2 in kinds else out


FAULTY = Embedder("faulty", faulty_embed_texts, batch=16, dimension=2)

ERROR_CODES = [
    "FILE_TOO_LARGE", "INVALID_FILENAME", "INVALID_CONTENT_TYPE", "INVALID_PDF_SIGNATURE", "EMPTY_FILE",
    "PAGE_EXTRACTION_FAILED", "PDF_EXTRACTION_FAILED", "NO_EXTRACTABLE_TEXT", "PDF_ENCRYPTED", "CORRUPTED_PDF",
    "GENERATION_RATE_LIMIT", "EMBEDDING_RATE_LIMIT", "EMBEDDING_INVALID_VALUE", "NO_CHUNKS_CREATED",
    "INDEXING_FAILED", "INDEX_COUNT_MISMATCH", "NO_DOCUMENTS_INDEXED", "RETRIEVAL_FAILED",
    "INVALID_RETRIEVAL_DISTANCE", "GENERATION_FAILED", "VALIDATION_ERROR",
]
ERROR_STATUSES = [400, 422, 413, 502, 503, 504, 0, 500, 409]


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error per event: every code with every status, and some without a code."""
    codes = F.array(*[F.lit(c) for c in ERROR_CODES])
    statuses = F.array(*[F.lit(s) for s in ERROR_STATUSES])
    n, m = len(ERROR_CODES), len(ERROR_STATUSES)
    pick = (F.col("event_id") % (n + 1)).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(pick < n, F.get(codes, pick)).alias("error_code"),
        statuses[(F.floor(F.col("event_id") / (n + 1)) % m).cast("int")].alias("http_status"),
        F.when(F.col("event_type") == "error", F.lit("TimeoutError")).alias("error_name"),
        F.when(F.col("event_type") == "view", F.lit(" Server says no. ")).alias("error_message"),
    )


EVENT_NAMES = {
    "view": "query_generation_completed",
    "purchase": "query_document_level_completed",
    "error": "query_abstained_retrieval_threshold",
    "click": "document_ingestion_completed",
    "signup": "http_request_completed",
}


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` written as lines of the event log."""
    names = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    value = F.col("value")
    timings = F.when(
        F.col("event_type") != "signup",
        F.struct(
            value.alias("validation_ms"),
            F.round(value * 2, 2).alias("retrieval_ms"),
            F.round(value * 3, 2).alias("generation_ms"),
            F.round(value * 6, 2).alias("total_ms"),
        ),
    )
    return table(spark, sf_dir, "events").select(
        F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                F.when(F.col("event_type") == "error", F.lit("WARNING")).otherwise(F.lit("INFO")).alias("level"),
                F.lit("pagewright").alias("logger"),
                names[F.col("event_type")].alias("event"),
                names[F.col("event_type")].alias("message"),
                F.struct(
                    F.when(F.col("event_type") == "signup", value).alias("latency_ms"),
                    timings.alias("timings_ms"),
                ).alias("fields"),
            )
        ).alias("line")
    )
