"""Operators of a training-data pipeline: formatting, fingerprints, deduplication, filters, mixing."""
