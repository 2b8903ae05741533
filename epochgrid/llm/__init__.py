"""Training-data operators: filters, extraction, near-duplicates, tokens, packing and search."""
