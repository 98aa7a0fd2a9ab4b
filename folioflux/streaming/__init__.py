"""Incremental ingest of arriving files: an extension beyond the batch operators."""
