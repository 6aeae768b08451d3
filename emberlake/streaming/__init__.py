"""Structured Streaming forms of ingest, projection and enrichment."""
