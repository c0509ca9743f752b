"""Scan of uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import EngineConfig


def scan_files(spark: SparkSession, path: str, cfg: EngineConfig, pattern: str = "*") -> DataFrame:
    """Files below ``path`` as ``(path, filename, content_type, content, length)``.

    The size test is pushed into the scan, so the content of oversized files is never read;
    they still appear, without content, to be rejected by name. Files of no bytes don't appear:
    Spark's reader passes over them.
    """
    def scan() -> DataFrame:
        return (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true")
            .load(path)
        )

    limit = cfg.max_upload_size_bytes
    small = scan().filter(F.col("length") <= limit).select("path", "content", "length")
    large = scan().filter(F.col("length") > limit).select(
        "path", F.lit(None).cast("binary").alias("content"), "length"
    )
    return small.unionByName(large).select(
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        F.lit(None).cast("string").alias("content_type"),
        "content",
        "length",
    )
