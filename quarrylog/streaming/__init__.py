"""Structured Streaming ingest and live tail."""
