"""Operators for training-data pipelines: search, near-duplicates, filters, mixing, packing."""
