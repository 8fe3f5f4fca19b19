"""Structured Streaming wrappers of the column-level extractors."""
