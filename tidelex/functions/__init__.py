"""Column functions: text, cascades, vectors, HTML."""
