"""Structured Streaming over event tables; beyond the reference, which has no streams."""
