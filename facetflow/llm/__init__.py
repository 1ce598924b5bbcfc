"""Training-data operators: deduplication, search, scoring, packing, encoding, sharding and formatting of texts."""
