"""Continuous ingest: stateful and table-backed deduplication of blobs."""
