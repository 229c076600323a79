"""Structured Streaming jobs: ingestion, counters, windows and limits."""
