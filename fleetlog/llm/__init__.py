"""Operators for preparing text corpora: cleaning, deduplication, search, tokens, packing."""
