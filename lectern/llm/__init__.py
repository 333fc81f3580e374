"""Operators for preparing training data: identification, cleaning, dedup, packing and output."""
