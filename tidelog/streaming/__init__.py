"""Structured Streaming forms of the same rules."""
