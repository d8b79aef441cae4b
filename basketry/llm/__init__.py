"""Operators for training-data pipelines: deduplication, scoring, filtering, formatting and packing of text corpora."""
