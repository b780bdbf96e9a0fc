"""Readers, ingest checks and sinks."""
