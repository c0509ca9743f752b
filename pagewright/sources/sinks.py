"""Wire shapes of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.documents import document_listing, sorted_document_ids


def answer_payloads(answers: DataFrame) -> DataFrame:
    """One JSON object per answer: answer, sources, status and retrieval counters."""
    return answers.select(
        "question_id",
        F.to_json(
            F.struct(
                "answer",
                F.transform(
                    "sources",
                    lambda s: F.struct(
                        s["source_id"].alias("source_id"),
                        s["filename"].alias("filename"),
                        s["chunk_id"].alias("chunk_id"),
                        s["start_page"].alias("start_page"),
                        s["end_page"].alias("end_page"),
                        s["sequence"].alias("sequence"),
                        s["rank"].alias("rank"),
                        s["distance"].alias("distance"),
                    ),
                ).alias("sources"),
                "status",
                F.struct(
                    F.col("candidate_count").alias("candidates"),
                    F.col("accepted_count").alias("accepted"),
                    "top_k",
                    "relevance_threshold",
                    "context_token_estimate",
                    "mode",
                ).alias("retrieval"),
            )
        ).alias("payload"),
    )


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers as JSON lines."""
    answer_payloads(answers).select("payload").write.mode("append").text(path)


def write_listing(chunks: DataFrame, path: str) -> None:
    """The document listing as JSON lines, in listing order."""
    document_listing(chunks).write.mode("overwrite").json(path)


def write_signature(chunks: DataFrame, path: str) -> None:
    """All document ids in order, separated by a pipe."""
    sorted_document_ids(chunks).write.mode("overwrite").option("lineSep", "|").text(path)
