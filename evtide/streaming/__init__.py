"""Structured Streaming forms of ingest, rollups, sessions and logs."""
