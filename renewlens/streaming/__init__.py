"""Structured Streaming versions of the incremental products."""
