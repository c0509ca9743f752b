"""Pages, questions and event logs as tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.schemas import LOG_EVENT, PAGE


def scan_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE) -> DataFrame:
    """Extracted pages: ``document_id, filename, page_number, text``."""
    return spark.read.schema(schema).parquet(path)


def stream_pages(
    spark: SparkSession, path: str, schema: T.StructType = PAGE, files_per_trigger: int = 1000
) -> DataFrame:
    """Pages arriving as files. All pages of a document come in one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def questions_from_requests(requests: DataFrame) -> DataFrame:
    """Parse JSON request bodies ``(question_id, body)`` without failing on bad ones.

    ``question_type`` is ``missing``, ``string`` or ``other``.
    """
    body = F.try_parse_json("body")
    question = F.try_variant_get(body, "$.question", "variant")
    kind = F.schema_of_variant(question)
    return requests.select(
        "question_id",
        F.when(kind == "STRING", F.get_json_object("body", "$.question")).alias("question"),
        F.when(kind.isNull() | (kind == "VOID"), F.lit("missing"))
        .when(kind == "STRING", F.lit("string"))
        .otherwise(F.lit("other"))
        .alias("question_type"),
    )


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Event log files, one JSON object per line."""
    return parse_log(spark.read.text(path), "value")


def parse_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same from a column of JSON lines; lines that do not parse give null fields. An
    event's own ``fields`` stay whole, as a variant."""
    return lines.select(F.from_json(column, LOG_EVENT).alias("e")).select("e.*")
