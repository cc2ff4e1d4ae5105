"""Operators of a training-data pipeline: deduplication, filtering, search, tokens, packing."""
