"""Operators of a training-data pipeline: extraction, filtering, deduplication, search, tokens and packing."""
