"""Operators for training-data pipelines: duplicates, cleaning, tokens, models."""
