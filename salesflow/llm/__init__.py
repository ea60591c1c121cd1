"""Training-data operators: deduplication, classification, mixing, packing, search and token output."""
