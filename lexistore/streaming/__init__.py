"""streaming layer of lexistore."""
