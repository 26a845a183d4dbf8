"""Training-data operators: deduplication, filters, mixing, packing, search and formatting."""
