"""Column functions: text, swim times, domain catalogues, similarity."""
