"""Ingestion of study files as they arrive."""

from cohortspark.streaming.ingest import ingest_studies, read_ingested

__all__ = ["ingest_studies", "read_ingested"]
