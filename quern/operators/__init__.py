"""Relational building blocks: ingest, rolling levels, events, features."""
