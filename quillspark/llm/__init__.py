"""Training-data operators: filters, scorers, near-duplicate search, archives, tokens."""
