"""Structured streaming ingest."""
