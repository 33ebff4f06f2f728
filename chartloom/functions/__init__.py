"""Column expressions: text normalisation, similarity, identifiers."""
