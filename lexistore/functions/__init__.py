"""functions layer of lexistore."""
