"""Operators for training-data pipelines: cleaning, deduplication, detection and token output."""
