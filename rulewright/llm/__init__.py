"""Training-data operators: extraction, near and exact duplicates, search, mixing, packing, labels, token files."""
