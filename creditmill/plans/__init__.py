"""Whole jobs: the feature table and the idempotent load."""
