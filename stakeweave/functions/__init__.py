"""Column functions: names, classification, dates, hashing, similarity."""
