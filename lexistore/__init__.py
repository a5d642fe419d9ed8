"""lexistore: ordered key-value collections as versioned Spark DataFrames."""

__version__ = "0.1.0"
