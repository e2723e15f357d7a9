"""Operators of a training-data pipeline: deduplication, packing, sharding, encoding, filters and classifiers."""
