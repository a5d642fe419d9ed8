"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; the ``opN_`` queries in ``queries`` derive
their digest columns from the operators' own outputs.
"""
