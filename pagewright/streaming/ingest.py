"""Documents arriving over time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagewright.config import EngineConfig
from pagewright.operators.embedding import Embedder
from pagewright.plans.ingest import ingest
from pagewright.session import scratch_scope
from pagewright.sources.files_api import Files
from pagewright.sources.store import ChunkStore


def stream_identity(spark, checkpoint: str) -> str:
    """The name of the stream that a checkpoint belongs to, written beside it once. Another
    stream, and a stream that starts afresh, have other names."""
    files = Files(spark, f"{checkpoint.rstrip('/')}-identity")
    files.write_new("id", uuid.uuid4().hex)
    return files.read("id")


def ingest_stream(
    pages: DataFrame,
    store: ChunkStore,
    checkpoint: str,
    reports: str,
    embedder: Embedder | None = None,
    cfg: EngineConfig | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Ingest every micro-batch. A replayed batch finds its own name in the store and adds
    nothing; its report replaces the earlier one. Batches are named after the stream, so that
    several streams can feed one store.

    A document is indexed with the pages of the micro-batch it first appears in. Pages that
    come later are not added: their report row is ``rejected`` with DOCUMENT_PAGES_DIFFER.
    """
    identity = stream_identity(store.spark, checkpoint)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        name = f"stream-{identity}-{batch_id:012d}"
        with scratch_scope(store.spark):
            report = ingest(batch, store, embedder, cfg, batch=name)
            report.write.mode("overwrite").parquet(f"{reports}/{name}")

    return (
        pages.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
