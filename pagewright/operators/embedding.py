"""Attaching vectors to texts.

An embedder is a function from a list of texts to a list of vectors. It runs in
Arrow batches over partitions of Spark's choosing; load models lazily inside the function
so that each Python worker loads them once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import text as tx
from pagewright.functions import vectors as vx

HASH_DIMENSION = 128
HASH_BLOCK = 256 * 1024
_GAP = re.compile(r"[^a-z0-9]")


@dataclass(frozen=True)
class Embedder:
    """``embed_texts`` maps texts to vectors; ``model_id`` is stored with every vector.
    ``dimension`` is the length of its vectors, where it is known."""

    model_id: str
    embed_texts: Callable[[Sequence[str]], Sequence[Sequence[float]]]
    batch: int = 16
    dimension: int | None = None


#: Stands before the error code that a row without a vector carries in place of a model.
FAILED = "error:"

# Error codes of embedding and their statuses.
EMBEDDING_STATUSES = {
    "EMPTY_EMBEDDING_INPUT": 400,
    "EMBEDDING_PROVIDER_ERROR": 502,
    "EMBEDDING_COUNT_MISMATCH": 502,
    "EMBEDDING_DIMENSION_MISMATCH": 502,
    "EMBEDDING_INVALID_VALUE": 502,
}
_CODE = re.compile(r"EMBEDDING_[A-Z_]+")


# Powers of 31 modulo 128; they repeat after four.
_POWERS = np.array([1, 31, 65, 95], dtype=np.uint8)
_IN_TOKEN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def _pieces(texts: Sequence[str]) -> Iterator[list[tuple[int, str]]]:
    """Groups of numbered texts of about ``HASH_BLOCK`` characters. Longer texts are cut between tokens."""
    group, size = [], 0
    for number, text in enumerate(texts):
        start = 0
        while start < len(text):
            gap = _GAP.search(text, start + HASH_BLOCK)
            end = gap.start() if gap else len(text)
            group.append((number, text[start:end]))
            size, start = size + end - start, end
            if size >= HASH_BLOCK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _bucket_counts(group: list[tuple[int, str]]) -> np.ndarray:
    """Tokens per bucket, a row for each number from the group's first to its last.

    The bucket of a token is the sum of its characters times falling powers of 31. With every
    character weighted by its place in the whole group, it is a difference of running sums;
    bytes that overflow keep it modulo 128.
    """
    numbers = np.array([number for number, _ in group]) - group[0][0]
    starts = np.cumsum([1] + [len(piece) + 1 for _, piece in group])
    chars = np.frombuffer(f" {' '.join(piece for _, piece in group)} ".encode("ascii", "replace"), dtype=np.uint8)
    inside = _IN_TOKEN[chars]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    before, last = edges[0::2], edges[1::2]
    weighted = chars.copy()
    for place in (1, 2, 3):
        weighted[place::4] *= _POWERS[4 - place]
    sums = np.cumsum(weighted, dtype=np.uint8)
    buckets = (sums[last] - sums[before]) * _POWERS[last % 4] % HASH_DIMENSION
    tokens = np.diff(np.searchsorted(last, starts))
    bins = np.repeat(numbers, tokens) * HASH_DIMENSION + buckets
    return np.bincount(bins, minlength=(numbers[-1] + 1) * HASH_DIMENSION).reshape(-1, HASH_DIMENSION)


def hash_embed_texts(texts: Sequence[str]) -> list[np.ndarray]:
    """Hashed bag of words with 128 buckets, scaled to unit length.

    Texts are expected in lower case; ``embed`` lower-cases them in the JVM. Nothing is kept
    between calls, and beside the vectors a call holds one block of characters.
    """
    counts = np.zeros((len(texts), HASH_DIMENSION))
    for group in _pieces(texts):
        counts[group[0][0] : group[-1][0] + 1] += _bucket_counts(group)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return list(np.divide(counts, norms, out=counts, where=norms > 0).astype(np.float32))


def hash_embedder() -> Embedder:
    return Embedder("hash-128", hash_embed_texts, batch=1024)


def _vector_or_code(vector: Sequence[float] | None, dimension: int | None) -> np.ndarray | str:
    try:
        found = np.asarray(vector, dtype=np.float32)
    except (TypeError, ValueError):
        return "EMBEDDING_INVALID_VALUE"
    if found.ndim != 1 or not len(found) or not np.isfinite(found).all():
        return "EMBEDDING_INVALID_VALUE"
    if dimension is not None and len(found) != dimension:
        return "EMBEDDING_DIMENSION_MISMATCH"
    return found


def embed_each(texts: list[str], embedder: Embedder) -> list[np.ndarray | str]:
    """A vector or an error code for every text. A call that fails, or returns another number
    of vectors, is made again with either half of its texts, until the texts at fault are alone:
    they cost the others nothing. A message that names an embedding code keeps it."""
    try:
        got = list(embedder.embed_texts(texts))
        code = None if len(got) == len(texts) else "EMBEDDING_COUNT_MISMATCH"
    except Exception as error:  # noqa: BLE001, whatever a model throws
        named = _CODE.match(str(error))
        code = named.group() if named else "EMBEDDING_PROVIDER_ERROR"
    if code is None:
        return [_vector_or_code(v, embedder.dimension) for v in got]
    if len(texts) == 1:
        return [code]
    half = len(texts) // 2
    return embed_each(texts[:half], embedder) + embed_each(texts[half:], embedder)


def embed(df: DataFrame, text_column: str, embedder: Embedder, refuse_blank: bool = False) -> DataFrame:
    """Add ``embedding`` and ``model_id`` to every row. A row whose text could not be embedded
    has no vector, and its error code behind ``FAILED`` as ``model_id``; so has a blank text
    with ``refuse_blank``.

    One call is served by one embedder, so no document can mix vectors of two models.
    """
    plain = embedder.embed_texts is hash_embed_texts
    text = tx.strip(F.coalesce(F.col(text_column), F.lit("")))
    text = F.lower(text) if plain else text
    batch = embedder.batch
    result = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("code", T.StringType())])

    def batch_vectors(texts: pa.Array) -> pa.Array:
        out: list = []
        # Texts stay in Arrow until their call; only those of one call are Python strings.
        for start in range(0, len(texts), batch):
            part = texts.slice(start, batch).to_pylist()
            asked = [t for t in part if t or not refuse_blank]
            found = iter(embed_each(asked, embedder) if asked else [])
            out += [next(found) if t or not refuse_blank else "EMPTY_EMBEDDING_INPUT" for t in part]
        failed = pa.array([v if isinstance(v, str) else None for v in out], pa.string())
        good = pa.array([None if isinstance(v, str) else v for v in out], pa.list_(pa.float32()))
        return pa.StructArray.from_arrays([good, failed], names=["vector", "code"])

    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Holds no batch while the next one is read.
        return map(batch_vectors, batches)

    # Only the text to embed crosses into Python; the other columns pass through Arrow.
    made = df.withColumn("_made", F.arrow_udf(vectors, result)(text))
    model = F.coalesce(F.concat(F.lit(FAILED), F.col("_made.code")), F.lit(embedder.model_id))
    return made.withColumn("embedding", F.col("_made.vector")).withColumn("model_id", model).drop("_made")


def embedding_error(model_id: Column) -> Column:
    """The error code of a row that ``embed`` left without a vector; null for others."""
    return F.when(F.startswith(model_id, F.lit(FAILED)), F.substring(model_id, len(FAILED) + 1, 100))


def embedding_errors(embedded: DataFrame) -> DataFrame:
    """``embed``'s result with ``error_code`` and ``error_status``, null for sound rows."""
    statuses = F.create_map(*[F.lit(x) for pair in EMBEDDING_STATUSES.items() for x in pair])
    code = embedding_error(F.col("model_id"))
    status = F.when(code.isNotNull(), F.coalesce(F.try_element_at(statuses, code), F.lit(502)))
    return embedded.withColumn("error_code", code).withColumn("error_status", status)


def vector_errors(df: DataFrame, stored_dimension: int | None = None) -> DataFrame:
    """Add ``error_code`` and ``error_status``, null for rows with a usable vector.

    The dimension expected of a new batch is the store's, or else must be the only one in
    the batch.
    """
    sizes = F.size("embedding")
    invalid = ~vx.is_finite_vector(F.col("embedding"))
    told = F.lit("EMBEDDING_INVALID_VALUE")
    if "model_id" in df.columns:
        told = F.coalesce(embedding_error(F.col("model_id")), told)
    if stored_dimension is None:
        span = df.filter(vx.is_finite_vector(F.col("embedding"))).agg(
            F.min(F.size("embedding")).alias("_lo"), F.max(F.size("embedding")).alias("_hi")
        )
        checked = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(span.withColumn("_one", F.lit(1))), "_one", "left"
        )
        mixed = (F.col("_lo") != F.col("_hi")) & ~invalid
        conflict = F.lit(False)
    else:
        checked = df
        mixed = F.lit(False)
        conflict = (sizes != stored_dimension) & ~invalid
    return (
        checked.withColumn(
            "error_code",
            F.when(invalid, told)
            .when(mixed, F.lit("INDEX_EMBEDDING_DIMENSION_MISMATCH"))
            .when(conflict, F.lit("INDEX_EMBEDDING_DIMENSION_CONFLICT")),
        )
        .withColumn(
            "error_status",
            F.when(invalid | mixed, F.lit(502)).when(conflict, F.lit(409)),
        )
        .drop("_one", "_lo", "_hi")
    )


def validate_vectors(df: DataFrame, stored_dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    checked = vector_errors(df, stored_dimension)
    return (
        checked.filter(F.col("error_code").isNull()).drop("error_code", "error_status"),
        checked.filter(F.col("error_code").isNotNull()),
    )


def document_vector_errors(vectors: DataFrame, stored_dimension: int | None = None) -> DataFrame:
    """One row per document of new vectors: their length and the error, null if none.

    Without a stored dimension, the first sound document by id sets it.
    """
    finite = vx.is_finite_vector(F.col("embedding"))
    named = "model_id" in vectors.columns
    told = F.when(~finite, embedding_error(F.col("model_id"))) if named else F.lit(None).cast("string")
    spans = vectors.groupBy("document_fingerprint").agg(
        F.count("*").alias("vectors"),
        F.count_if(~finite).alias("invalid_vectors"),
        F.min(F.when(finite, F.size("embedding"))).alias("dimension"),
        F.max(F.when(finite, F.size("embedding"))).alias("max_dimension"),
        F.min(told).alias("told"),
    )
    sound = (F.col("invalid_vectors") == 0) & (F.col("dimension") == F.col("max_dimension"))
    if stored_dimension is None:
        first = spans.agg(
            F.min_by("dimension", F.when(sound, F.col("document_fingerprint"))).alias("_expected")
        )
        spans = spans.withColumn("_one", F.lit(1)).join(
            F.broadcast(first.withColumn("_one", F.lit(1))), "_one"
        ).drop("_one")
    else:
        spans = spans.withColumn("_expected", F.lit(stored_dimension))
    return spans.withColumn(
        "error_code",
        F.when(F.col("invalid_vectors") > 0, F.coalesce("told", F.lit("EMBEDDING_INVALID_VALUE")))
        .when(F.col("dimension") != F.col("max_dimension"), F.lit("INDEX_EMBEDDING_DIMENSION_MISMATCH"))
        .when(F.col("dimension") != F.col("_expected"), F.lit("INDEX_EMBEDDING_DIMENSION_CONFLICT")),
    ).drop("_expected", "told")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents whose numbers of chunks and vectors differ. Both sides are counted before
    they meet, so no chunk is shuffled."""
    wanted = chunks.groupBy("document_fingerprint").agg(F.count("*").alias("chunks"))
    got = vectors.groupBy("document_fingerprint").agg(F.count("*").alias("vectors"))
    return (
        wanted.join(got, "document_fingerprint", "full_outer")
        .select(
            "document_fingerprint",
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.coalesce("vectors", F.lit(0)).alias("vectors"),
        )
        .filter(F.col("chunks") != F.col("vectors"))
        .withColumn("error_code", F.lit("CHUNK_EMBEDDING_COUNT_MISMATCH"))
    )


def mixed_models(vectors: DataFrame) -> DataFrame:
    """Documents whose vectors come from more than one model."""
    return (
        vectors.groupBy("document_fingerprint")
        .agg(F.min("model_id").alias("first_model"), F.max("model_id").alias("last_model"))
        .filter(F.col("first_model") != F.col("last_model"))
    )
