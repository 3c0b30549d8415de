"""Column builders: text, URLs, numbers, fingerprints, vectors, lexicons and scores."""
