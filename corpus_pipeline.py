"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated
substrings are cut out, and what is left is packed into sequences.

Each stage takes what its predecessor kept, is written as Parquet and read again. Defined
results for nulls, empty texts and tables, repeated rows and further columns are those of the
operators that the stages call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.chosen_path import first_of_each_group
from pagewright.llm.common import stored
from pagewright.llm.packing import Packing, pack_documents, special_tokens
from pagewright.llm.suffix_dedup import without_repeats
from pagewright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cfg = Packing(specials=special_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cfg)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: A classifier, word shingles' components and byte-exact repeats are beyond one SQL statement;
#: the tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
