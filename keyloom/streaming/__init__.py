"""Incremental operations on Structured Streaming."""
