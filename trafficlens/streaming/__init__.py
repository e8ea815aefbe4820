"""Structured Streaming forms of the ingest, scoring and window jobs."""
