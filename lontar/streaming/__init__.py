"""Streaming twins of the batch aggregations."""
