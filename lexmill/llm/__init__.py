"""Operators of a training-data pipeline: scans, models, deduplication, mixing, sharding."""
