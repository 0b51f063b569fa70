"""Structured Streaming forms of ingestion and of two reports."""
