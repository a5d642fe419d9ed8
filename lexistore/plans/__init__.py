"""plans layer of lexistore."""
