"""Training-data operators: search, classification, dedup, mixing, tokens."""
