"""Ingest: pages -> gate -> duplicates -> chunks -> vectors -> store -> report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.operators.admission import document_gate, file_errors
from pagewright.operators.chunking import chunk_documents
from pagewright.operators.embedding import Embedder, embed, hash_embedder
from pagewright.session import materialize
from pagewright.sources.store import ChunkStore

# Report wording.
DONE_MESSAGE = "Document ingestion completed successfully. %d pages processed, %d chunks created, %d vectors indexed."
DUPLICATE_MESSAGE = "This document is already indexed. No duplicate embedding or indexing was performed."


def first_uploads(uploads: DataFrame) -> DataFrame:
    """For each document the upload that comes first. A minimum combines before the shuffle,
    so many copies of one document are no burden."""
    return uploads.groupBy("document_id").agg(F.min("upload_id").alias("upload_id"))


def uploads_to_index(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """First uploads of documents the store does not hold yet."""
    known = stored.select(F.col("document_fingerprint").alias("document_id"))
    return first_uploads(uploads).join(known, "document_id", "left_anti")


def ingest_report(
    uploads: DataFrame, to_index: DataFrame, chunk_counts: DataFrame, rejected: DataFrame | None = None
) -> DataFrame:
    """One row per upload. ``chunk_counts`` has ``document_id`` and ``chunk_count``, and may
    have ``stored_pages``: an upload of a stored document with another number of pages is no
    duplicate of it, and is refused as DOCUMENT_PAGES_DIFFER. ``rejected`` names documents
    refused by the store, with an ``error_code``.

    Whether an upload is the one that was indexed is looked up by upload, so copies of one
    document do not meet in one task for it.
    """
    indexed = to_index.select("upload_id", F.lit(True).alias("_indexed"))
    joined = uploads.join(indexed, "upload_id", "left").join(chunk_counts, "document_id", "left")
    refused = F.lit(None).cast("string")
    if rejected is not None:
        refused = F.col("_refused")
        joined = joined.join(
            rejected.select(
                F.col("document_fingerprint").alias("document_id"), F.col("error_code").alias("_refused")
            ),
            "document_id",
            "left",
        )
    count = F.coalesce("chunk_count", F.lit(0))
    failed = F.col("error_code").isNotNull()
    new = F.coalesce("_indexed", F.lit(False))
    partial = F.lit(None).cast("string")
    if "stored_pages" in chunk_counts.columns:
        differs = ~new & (F.col("stored_pages") != F.col("page_count"))
        partial = F.when(differs, F.lit("DOCUMENT_PAGES_DIFFER"))
    code = F.coalesce("error_code", refused, F.when(count == 0, F.lit("NO_CHUNKS_CREATED")), partial)
    failed = failed | partial.isNotNull()
    done = F.format_string(DONE_MESSAGE, "page_count", count, count)
    return joined.select(
        "upload_id",
        "document_id",
        "filename",
        F.col("page_count").cast("int").alias("page_count"),
        F.col("empty_page_count").cast("int").alias("empty_page_count"),
        F.when(failed, F.lit(0)).otherwise(count).cast("int").alias("chunk_count"),
        F.when(failed, F.lit(0)).otherwise(count).cast("int").alias("indexed_count"),
        F.when(code.isNotNull(), F.lit("rejected"))
        .when(new, F.lit("indexed"))
        .otherwise(F.lit("already_indexed"))
        .alias("status"),
        F.when(code.isNotNull(), code).when(new, done).otherwise(F.lit(DUPLICATE_MESSAGE)).alias("message"),
        code.alias("error_code"),
    )


def _pages_of(pages: DataFrame, kept: DataFrame, dropped: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Pages of the uploads to index. Both lists are written tables of one narrow row per
    upload; the shorter one is broadcast if it is short, and pages then stay where they are."""
    most = cfg.broadcast_documents
    n_dropped, n_kept = dropped.count(), kept.count()
    if n_dropped == 0:
        return pages
    if n_dropped <= min(n_kept, most):
        return pages.join(F.broadcast(dropped.select("upload_id")), "upload_id", "left_anti")
    if n_kept <= most:
        return pages.join(F.broadcast(kept.select("upload_id")), "upload_id", "left_semi")
    return pages.join(kept.select("upload_id"), "upload_id", "left_semi")


def ingest(
    pages: DataFrame,
    store: ChunkStore,
    embedder: Embedder | None = None,
    cfg: EngineConfig | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Index the documents of ``pages`` that are new and return the report.

    ``pages`` has ``document_id`` (the fingerprint of the file's bytes), ``filename``,
    ``page_number`` and ``text``, and ``upload_id`` where the same document may come more
    than once; the smallest one counts as the first. Duplicates are found before any text is
    cut or embedded.
    """
    cfg = cfg or EngineConfig()
    embedder = embedder or hash_embedder()
    if "upload_id" not in pages.columns:
        pages = pages.withColumn("upload_id", F.col("document_id"))

    batch = batch or uuid.uuid4().hex
    # A batch run again is judged against the store as it was before its first run.
    stored = store.directory().filter(F.col("batch") != batch)
    uploads = materialize(
        document_gate(pages, ["upload_id"]).drop("error_details", "meaningful"), "uploads"
    )
    accepted = uploads.filter(F.col("error_code").isNull())
    kept = materialize(uploads_to_index(accepted, stored), "uploads-to-index")
    dropped = uploads.join(kept, "upload_id", "left_anti")

    chunks = chunk_documents(_pages_of(pages, kept, dropped, cfg), cfg)
    named = kept.select(F.col("document_id").alias("document_fingerprint"))
    store.append(embed(chunks, "text", embedder, refuse_blank=True), batch, empty_ok=True, documents=named)

    counts = store.directory().select(F.col("document_fingerprint").alias("document_id"), "chunk_count", "stored_pages")
    counts = counts.join(uploads.select("document_id").distinct(), "document_id", "left_semi")
    rejected = store.rejected(batch)
    # Another writer was first with these: they are duplicates, not failures.
    late = rejected.filter("error_code = 'DOCUMENT_ALREADY_INDEXED'")
    kept = kept.join(late.select(F.col("document_fingerprint").alias("document_id")), "document_id", "left_anti")
    return ingest_report(uploads, kept, counts, rejected.filter("error_code != 'DOCUMENT_ALREADY_INDEXED'"))


def ingest_files(
    files: DataFrame,
    pages: DataFrame,
    store: ChunkStore,
    embedder: Embedder | None = None,
    cfg: EngineConfig | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Admit files, index the pages of the admitted ones, and report on every file.

    ``files`` (from ``scan_files``) has ``path``, ``filename``, ``content_type``, ``content`` and
    optionally ``length``; ``pages`` has ``path``, ``page_number`` and ``text``, as an extractor
    left them. The bytes are read once, to be checked and hashed, and go no further: the hash is
    the document id. A refused file has its code in the report; an admitted one without pages is
    NO_EXTRACTABLE_TEXT. Pages of refused or unknown files are not indexed.
    """
    cfg = cfg or EngineConfig()
    judged = file_errors(files, cfg).select(
        F.col("path").alias("upload_id"),
        F.when(F.col("error_code").isNull(), F.sha2("content", 256)).alias("document_id"),
        F.coalesce(F.col("clean_filename"), F.lit("")).alias("filename"),
        "error_code",
    )
    judged = materialize(judged, "judged-files")
    admitted = judged.filter("error_code is null").drop("error_code")
    own = pages.select(F.col("path").alias("upload_id"), "page_number", "text").join(admitted, "upload_id")
    report = materialize(ingest(own, store, embedder, cfg, batch), "ingest-report")
    bare = admitted.join(report.select("upload_id"), "upload_id", "left_anti")
    refused = judged.filter("error_code is not null").unionByName(bare.withColumn("error_code", F.lit("NO_EXTRACTABLE_TEXT")))
    none = F.lit(0)
    return report.unionByName(
        refused.select(
            "upload_id", "document_id", "filename", none.alias("page_count"), none.alias("empty_page_count"),
            none.alias("chunk_count"), none.alias("indexed_count"), F.lit("rejected").alias("status"),
            F.col("error_code").alias("message"), "error_code",
        )
    )
