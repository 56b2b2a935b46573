"""Column functions: text normalisers, identifiers, numbering, similarity."""
