"""Operators of a training-data pipeline: quality, search, duplicates, leaks, secrets, mixing, archives, extraction."""
