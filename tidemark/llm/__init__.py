"""Training-data operators: filters, near-duplicate search, mixing and packing."""
