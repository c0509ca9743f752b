"""Explicit schemas of the engine's tables."""

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("document_fingerprint", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start_page", T.IntegerType()),
        T.StructField("end_page", T.IntegerType()),
        T.StructField("sequence", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("source_boundaries", T.ArrayType(T.StringType())),
        T.StructField("document_page_count", T.IntegerType()),
    ]
)

STORED_CHUNK = T.StructType(
    CHUNK.fields
    + [
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model_id", T.StringType()),
    ]
)

#: A row per document of a store.
DIRECTORY = T.StructType(
    [
        T.StructField("document_fingerprint", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("batch", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("chunk_count", T.IntegerType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("stored_pages", T.IntegerType()),
    ]
)

QUESTION = T.StructType(
    [T.StructField("question_id", T.LongType()), T.StructField("question", T.StringType())]
)

LOG_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("message", T.StringType()),
        # Open: every event has fields of its own.
        T.StructField("fields", T.VariantType()),
        T.StructField("exception", T.StringType()),
    ]
)

CHUNK_COLUMNS = [f.name for f in CHUNK.fields]
STORED_COLUMNS = [f.name for f in STORED_CHUNK.fields]
