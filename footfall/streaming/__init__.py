"""Structured Streaming: ingest pipeline, rollups, live activity."""
