"""Spark-native engine for leaflet records: ingestion, chunking, vector retrieval and guarded answers."""

from kervan.config import EngineConfig
from kervan.session import build_session

__all__ = ["EngineConfig", "build_session"]
