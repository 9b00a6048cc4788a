"""Operators of a training-data pipeline: near-copies, contamination, archives, quality, tokens."""
