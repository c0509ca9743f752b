"""Questions arriving over time."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.config import EngineConfig
from pagewright.operators.embedding import Embedder
from pagewright.operators.overview import overview_of, render_overview, select_documents
from pagewright.plans.answer import Generator, answer_batch
from pagewright.session import materialize, scratch_scope
from pagewright.sources.files_api import Files
from pagewright.sources.store import ChunkStore, Snapshot


def store_overview(store: ChunkStore, cfg: EngineConfig, snapshot: Snapshot | None = None) -> DataFrame:
    """The rendered overview of a store: the listing comes from its directory, and chunks are
    read of the shown documents only."""
    snap = snapshot or store.snapshot()
    shown = materialize(select_documents(store.documents(snap), cfg), "shown-documents")
    chunks = store.chunks(shown.select(F.col("document_id").alias("document_fingerprint")), snap)
    return render_overview(overview_of(shown, chunks, cfg))


def kept_overview(store: ChunkStore, folder: str, cfg: EngineConfig, snapshot: Snapshot) -> DataFrame:
    """The overview of one version of a store, written below ``folder`` when first asked for."""
    told = hashlib.sha256(repr(cfg).encode()).hexdigest()[:12]
    path = f"{folder}/version={snapshot.version:012d}-{told}"
    if "_SUCCESS" not in Files(store.spark, path).marks():
        store_overview(store, cfg, snapshot).write.mode("overwrite").parquet(path)
    return store.spark.read.parquet(path)


def answer_stream(
    questions: DataFrame,
    store: ChunkStore,
    checkpoint: str,
    answers: str,
    embedder: Embedder | None = None,
    generator: Generator | None = None,
    cfg: EngineConfig | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Answer every micro-batch against the store as it stands when the batch starts.
    Answers go to ``answers``, rejected questions to a sibling folder, and the overview of each
    version of the store to another: it is made once, not by every micro-batch."""
    cfg = cfg or EngineConfig()

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        name = f"batch={batch_id:012d}"
        with scratch_scope(store.spark):
            snap = store.snapshot()
            overview = kept_overview(store, f"{answers}-overview", cfg, snap)
            answered, rejected = answer_batch(batch, store.chunks(snapshot=snap), embedder, generator, cfg, overview)
            answered.write.mode("overwrite").parquet(f"{answers}/{name}")
            rejected.write.mode("overwrite").parquet(f"{answers}-rejected/{name}")

    return (
        questions.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
