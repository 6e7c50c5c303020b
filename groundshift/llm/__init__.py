"""Training-data operators: quality, duplicates, leaks, personal data, extraction, tokens and packing."""
