"""Incremental ingestion of ride files with Structured Streaming."""

from cadence.streaming.ingest import ingest_ride_files, start_ride_ingest  # noqa: F401
