"""Document retrieval analytics on Spark: corpus ingest and batch question answering as DataFrames."""

from pagewright.config import EngineConfig

__all__ = ["EngineConfig"]
