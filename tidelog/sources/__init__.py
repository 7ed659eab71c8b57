"""Readers of text records and idempotent writers."""
