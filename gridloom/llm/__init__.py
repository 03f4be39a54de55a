"""Training-data operators: scoring, deduplication, search, packing, personal data."""
