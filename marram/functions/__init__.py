"""Column functions: text, fuzzy similarity and parsing."""
