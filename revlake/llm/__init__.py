"""Training-data operators: tokenising, search, filtering, near-duplicates and mixing."""
