"""Training-data operators: filtering, sharding, deduplication, tokenising and media columns."""
