"""Engine parameters, checked once on construction."""

from __future__ import annotations

from dataclasses import dataclass

METRICS = ("cosine", "l2", "ip")


@dataclass(frozen=True)
class EngineConfig:
    # Semantics of ingest and retrieval.
    chunk_size: int = 500
    chunk_overlap: int = 50
    top_k: int = 5
    relevance_threshold: float = 0.70
    max_context_tokens: int = 4000
    metric: str = "cosine"
    max_question_length: int = 10_000
    max_upload_size_bytes: int = 10 * 1024 * 1024
    overview_max_chunks_per_document: int = 10
    overview_excerpt_words: int = 160
    overview_max_documents: int = 5
    enable_overview_fallback: bool = True
    embedding_batch: int = 16
    # Physical sizing. These never change a result.
    long_document_pages: int = 2_000
    long_document_characters: int = 16_000_000
    folio_words: int = 100_000
    folios_per_span: int = 4_096
    broadcast_questions: int = 20_000
    broadcast_bytes: int = 64 * 1024 * 1024
    broadcast_documents: int = 100_000
    broadcast_chunk_ids: int = 500_000

    def __post_init__(self) -> None:
        positive = (
            "chunk_size",
            "top_k",
            "max_context_tokens",
            "max_question_length",
            "max_upload_size_bytes",
            "embedding_batch",
            "long_document_pages",
            "long_document_characters",
            "folio_words",
            "folios_per_span",
            "broadcast_questions",
            "broadcast_bytes",
        )
        for name in positive:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than zero")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be >= 0 and smaller than chunk_size")
        if not 0 < self.relevance_threshold <= 2:
            raise ValueError("relevance_threshold must be > 0 and <= 2")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {', '.join(METRICS)}")
