"""Training-data operators: tokenising, filtering, de-duplicating, scoring and packing text."""
