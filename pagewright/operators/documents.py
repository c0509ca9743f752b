"""Document listings and corpus-wide summaries of a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_summaries(chunks: DataFrame) -> DataFrame:
    """One row per document. Only aggregates that combine before the shuffle are used."""
    return (
        chunks.filter(F.coalesce("document_fingerprint", F.lit("")) != "")
        .groupBy(F.col("document_fingerprint").alias("document_id"))
        .agg(
            F.min_by("filename", F.struct("sequence", "chunk_id")).alias("filename"),
            F.count("*").cast("int").alias("chunk_count"),
            F.greatest(F.max("end_page"), F.max("document_page_count")).alias("page_count"),
        )
    )


def list_documents(chunks: DataFrame) -> DataFrame:
    """Summaries ordered by lower-case filename, then id."""
    return document_summaries(chunks).orderBy(F.lower("filename"), "document_id")


def document_listing(chunks: DataFrame) -> DataFrame:
    """The listing with the corpus total beside every document."""
    summaries = document_summaries(chunks)
    total = summaries.agg(F.sum("chunk_count").alias("total_chunks")).withColumn("_one", F.lit(1))
    return (
        summaries.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .drop("_one")
        .orderBy(F.lower("filename"), "document_id")
    )


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """Counts of documents, chunks and pages, and a label for them."""
    totals = document_summaries(chunks).agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"),
        F.min("filename").alias("_only"),
    )
    return totals.select(
        "documents",
        "chunks",
        "pages",
        F.when(F.col("documents") == 0, F.lit("None indexed"))
        .when(F.col("documents") == 1, F.col("_only"))
        .otherwise(F.concat(F.col("documents").cast("string"), F.lit(" documents")))
        .alias("label"),
    )


def sorted_document_ids(chunks: DataFrame) -> DataFrame:
    """All document ids in order. Written as text with ``lineSep='|'`` they are the corpus
    signature in full."""
    return (
        chunks.filter(F.coalesce("document_fingerprint", F.lit("")) != "")
        .select(F.col("document_fingerprint").alias("document_id"))
        .distinct()
        .orderBy("document_id")
    )


def corpus_signature(chunks: DataFrame) -> DataFrame:
    """One row that changes whenever the set of documents does.

    Two corpora are equal when their sorted ids, joined by a pipe, are. The ids of a large
    corpus do not fit into one row, so they are spread over 65536 bins by their hash, joined
    and hashed per bin, and the bins' hashes are joined and hashed in bin order.
    """
    ids = (
        chunks.filter(F.coalesce("document_fingerprint", F.lit("")) != "")
        .select(F.col("document_fingerprint").alias("document_id"))
        .distinct()
    )
    bins = (
        ids.groupBy(F.substring(F.sha2("document_id", 256), 1, 4).alias("bin"))
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_list("document_id")).alias("ids"))
        .select("bin", "n", F.sha2(F.array_join("ids", "|"), 256).alias("digest"))
    )
    return bins.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.sha2(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("bin", "digest"))), lambda b: b["digest"]), "|"
            ),
            256,
        ).alias("signature"),
    )


def store_dimension(chunks: DataFrame) -> DataFrame:
    """Number of stored chunks and the length of their vectors (null when empty)."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.max(F.size("embedding")).alias("dimension")
    )
