"""sources layer of lexistore."""
