"""operators layer of lexistore."""
