"""Index batches: chunks and their vectors from two tables, paired and stored unit by unit.

A unit (``batch_id``) is what one upload brings: the chunks of one document and a vector for
each. It is stored whole or not at all; a unit with an error is set apart with its code and
costs the others nothing. Chunk ids and vector ids meet in a full outer join of narrow rows that
are counted before; texts and vectors meet afterwards, for sound units only. Both joins are on
the chunk id, so a unit may hold any share of the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.schemas import CHUNK_COLUMNS, STORED_COLUMNS
from pagewright.session import materialize
from pagewright.sources.store import ChunkStore

KEY = ["batch_id", "chunk_id"]
SALTS = 32

# Error codes of an index batch and their statuses.
STATUSES = {
    "NO_CHUNKS_TO_INDEX": 422,
    "CHUNK_EMBEDDING_COUNT_MISMATCH": 500,
    "MIXED_DOCUMENT_CHUNKS": 500,
    "DOCUMENT_ALREADY_INDEXED": 409,
    "INDEX_EMBEDDING_DIMENSION_MISMATCH": 502,
    "EMBEDDING_INVALID_VALUE": 502,
    "INDEX_EMBEDDING_DIMENSION_CONFLICT": 409,
}


def error_status(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    return F.try_element_at(pairs, code)


def pair_errors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per unit: ``batch_id``, ``document_fingerprint``, ``chunk_count``,
    ``vector_count``, ``strangers`` (ids without a partner, or with several), ``error_code``.

    A unit is sound if every chunk has one vector and every vector one chunk, and all chunks are
    of one document. Equal numbers are not enough: a vector of another chunk is a stranger.
    """
    doc = F.col("document_fingerprint")
    wanted = chunks.groupBy(*KEY).agg(F.count("*").alias("chunks"), F.min(doc).alias("low"), F.max(doc).alias("high"))
    got = vectors.groupBy(*KEY).agg(F.count("*").alias("vectors"))
    none = F.lit(0).cast("bigint")
    met = wanted.join(got, KEY, "full_outer").withColumns(
        {"chunks": F.coalesce("chunks", none), "vectors": F.coalesce("vectors", none)}
    )
    units = met.groupBy("batch_id").agg(
        F.sum("chunks").alias("chunk_count"),
        F.sum("vectors").alias("vector_count"),
        F.count_if((F.col("chunks") != 1) | (F.col("vectors") != 1)).alias("strangers"),
        F.min("low").alias("document_fingerprint"),
        F.max("high").alias("last"),
    )
    code = (
        F.when(F.col("chunk_count") == 0, F.lit("NO_CHUNKS_TO_INDEX"))
        .when(F.col("strangers") > 0, F.lit("CHUNK_EMBEDDING_COUNT_MISMATCH"))
        .when(F.col("document_fingerprint") != F.col("last"), F.lit("MIXED_DOCUMENT_CHUNKS"))
    )
    return units.select(
        "batch_id", "document_fingerprint", "chunk_count", "vector_count", "strangers", code.alias("error_code")
    )


def paired(chunks: DataFrame, vectors: DataFrame, units: DataFrame) -> DataFrame:
    """Stored chunks of the sound units. The few units set apart are dealt to salts, as one of
    them may hold a large share of the rows."""
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int").alias("salt")
    apart = units.filter(F.col("error_code").isNotNull()).select(
        "batch_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    sound = chunks.select("batch_id", *CHUNK_COLUMNS, salt).join(apart, ["batch_id", "salt"], "left_anti")
    return sound.join(vectors.select(*KEY, "embedding", "model_id"), KEY).select("batch_id", *STORED_COLUMNS)


def index_with_vectors(chunks: DataFrame, vectors: DataFrame, store: ChunkStore, batch: str | None = None) -> DataFrame:
    """Index the units of ``chunks`` (``batch_id`` and a chunk's columns) with their ``vectors``
    (``batch_id``, ``chunk_id``, ``embedding``, ``model_id``) and return the report: one row per
    unit with its counts, ``indexed_count``, ``error_code`` and ``error_status``.

    Of two sound units with the same document the one with the smaller id is indexed.
    """
    batch = batch or uuid.uuid4().hex
    units = materialize(pair_errors(chunks, vectors), "index-units")
    sound = units.filter(F.col("error_code").isNull())
    first = sound.groupBy("document_fingerprint").agg(F.min("batch_id").alias("batch_id"))
    late = sound.join(first, ["document_fingerprint", "batch_id"], "left_anti")
    late = late.withColumn("error_code", F.lit("DOCUMENT_ALREADY_INDEXED"))
    units = units.join(late.select("batch_id", F.col("error_code").alias("late")), "batch_id", "left")
    units = materialize(units.withColumn("error_code", F.coalesce("error_code", "late")).drop("late"), "index-verdicts")
    store.append(paired(chunks, vectors, units).drop("batch_id"), batch, empty_ok=True)
    refused = store.rejected(batch).withColumnRenamed("error_code", "refused")
    held = store.directory().filter(F.col("batch") == batch).select("document_fingerprint", "chunk_count")
    told = units.join(refused, "document_fingerprint", "left").join(
        held.withColumnRenamed("chunk_count", "indexed"), "document_fingerprint", "left"
    )
    code = F.coalesce("error_code", "refused")
    return told.select(
        "batch_id",
        "document_fingerprint",
        "chunk_count",
        "vector_count",
        F.when(code.isNull(), F.coalesce("indexed", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("indexed_count"),
        code.alias("error_code"),
        error_status(code).alias("error_status"),
    )
