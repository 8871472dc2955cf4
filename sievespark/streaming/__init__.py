"""Incremental variants on Structured Streaming."""
