"""Incremental ingestion of shot logs with Structured Streaming."""
