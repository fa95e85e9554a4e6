"""Readers and writers: Parquet, CSV, JSON, YAML, capture folders, text payloads, run records."""
