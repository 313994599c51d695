"""Operators of a training-data pipeline: deduplication, filters, tokens, formatting, packing."""
