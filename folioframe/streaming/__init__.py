"""Structured Streaming forms of the progress, lease and ingest operators."""
