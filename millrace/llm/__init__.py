"""Operators of a training-data pipeline: filtering, deduplication, tokenization, packing and archives."""
