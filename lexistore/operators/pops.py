"""Destructive reads: what is popped, and the collection without it, from one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistore.functions.bounds import Bound, Unbounded
from lexistore.operators.collection import Collection


def pop_first(c: Collection, n: int = 1, start: Bound = Unbounded, end: Bound = Unbounded) -> tuple[DataFrame, Collection]:
    """The n least entries within the bounds, and the rest.  Nothing is popped from an empty range."""
    return _pop(c, n, start, end, False)


def pop_last(c: Collection, n: int = 1, start: Bound = Unbounded, end: Bound = Unbounded) -> tuple[DataFrame, Collection]:
    return _pop(c, n, start, end, True)


def _pop(c: Collection, n: int, start: Bound, end: Bound, reverse: bool) -> tuple[DataFrame, Collection]:
    popped = c.take(n, start, end, reverse)
    gone = popped.select(F.col(c.key).alias(c.key))
    return popped, Collection(c.df.join(gone, c.key, "left_anti"), c.key)


def clear(c: Collection) -> Collection:
    return Collection(c.df.limit(0), c.key)
