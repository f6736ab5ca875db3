"""Training-data operators: scoring, tokenising, filtering, deduplication and search over text tables."""
