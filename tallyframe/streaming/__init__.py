"""Structured Streaming ingest with per-batch idempotent state, notifier step and streaming reports."""
