"""Structured Streaming ingest with incremental roll-up refresh (ST-3, ST-5..ST-7)."""
