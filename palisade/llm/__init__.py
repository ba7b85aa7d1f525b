"""Training-data operators: encoding, mixing, extraction, sharding, deduplication, filtering and search."""
