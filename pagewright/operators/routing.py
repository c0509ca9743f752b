"""Routing a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.functions.routing import is_document_level, normalize_question


def route_questions(questions: DataFrame) -> DataFrame:
    """Add ``normalized`` and ``document_level`` to questions."""
    normalized = questions.withColumn("normalized", normalize_question(F.col("question")))
    blank = tx.is_blank(F.coalesce("question", F.lit("")))
    return normalized.withColumn(
        "document_level", F.when(blank, F.lit(False)).otherwise(is_document_level(F.col("normalized")))
    )
