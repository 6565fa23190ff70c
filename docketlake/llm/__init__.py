"""Operators that prepare training data: deduplication, quality, privacy, tokens and packing."""
