"""Reads of an ordered collection: every operator returns a lazy DataFrame or a scalar.

A collection is a DataFrame with a unique key column; the other columns are the value.
Point and range reads are plain comparisons on the key, so they reach the Parquet scan;
the order is only sorted for when it is asked for.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexistore.functions.bounds import Bound, Excluded, Included, Unbounded, prefix_range, text_prefix_range
from lexistore.operators.checksum import checksum
from lexistore.operators.neighbours import nearest_above, nearest_below, range_of, split_points


class Collection:
    def __init__(self, df: DataFrame, key: str = "key"):
        self.df, self.key = df, key

    def __repr__(self) -> str:
        return f"Collection(key={self.key}, {self.df})"

    def dump(self, n: int = 20) -> str:
        """The first n entries in key order as text, for looking at them; the whole collection never reaches the driver."""
        rows = [", ".join(f"{c}: {v!r}" for c, v in r.asDict().items()) for r in self.take(n + 1).collect()]
        return "\n".join([*rows[:n], *["..."] * (len(rows) > n)])

    def _where(self, start: Bound, end: Bound) -> DataFrame:
        k, df = F.col(self.key), self.df
        if isinstance(start, Included):
            df = df.where(k >= F.lit(start.at))
        elif isinstance(start, Excluded):
            df = df.where(k > F.lit(start.at))
        if isinstance(end, Included):
            df = df.where(k <= F.lit(end.at))
        elif isinstance(end, Excluded):
            df = df.where(k < F.lit(end.at))
        return df

    def _sorted(self, df: DataFrame, reverse: bool) -> DataFrame:
        return df.orderBy(F.col(self.key).desc() if reverse else F.col(self.key).asc())

    # points

    def get(self, key: Any) -> DataFrame:
        return self.df.where(F.col(self.key) == F.lit(key))

    def get_many(self, probes: DataFrame, on: str, found: str = "found") -> DataFrame:
        """Every probe with its entry's columns (null if there is none) and whether it was found."""
        entries = self.df.withColumn(found, F.lit(True)).withColumnRenamed(self.key, on)
        return probes.join(entries, on, "left").withColumn(found, F.coalesce(F.col(found), F.lit(False)))

    def contains_key(self, key: Any) -> bool:
        return not self.get(key).select(self.key).isEmpty()

    def contained(self, probes: DataFrame, on: str) -> DataFrame:
        return probes.join(self.df.select(F.col(self.key).alias(on)), on, "left_semi")

    def not_contained(self, probes: DataFrame, on: str) -> DataFrame:
        return probes.join(self.df.select(F.col(self.key).alias(on)), on, "left_anti")

    # neighbours

    def get_lt(self, key: Any) -> DataFrame:
        return self._sorted(self._where(Unbounded, Excluded(key)), True).limit(1)

    def get_gt(self, key: Any) -> DataFrame:
        return self._sorted(self._where(Excluded(key), Unbounded), False).limit(1)

    def get_lt_many(self, probes: DataFrame, on: str, buckets: int | None = None) -> DataFrame:
        """Every probe with the greatest entry strictly below it."""
        return nearest_below(self.df, self.key, probes, on, buckets)

    def get_gt_many(self, probes: DataFrame, on: str, buckets: int | None = None) -> DataFrame:
        return nearest_above(self.df, self.key, probes, on, buckets)

    def first(self) -> DataFrame:
        return self._sorted(self.df, False).limit(1)

    def last(self) -> DataFrame:
        return self._sorted(self.df, True).limit(1)

    # scans

    def iter(self, reverse: bool = False) -> DataFrame:
        return self._sorted(self.df, reverse)

    def range(self, start: Bound = Unbounded, end: Bound = Unbounded, reverse: bool | None = None) -> DataFrame:
        """Entries between the bounds; sorted only if ``reverse`` says how.  Inverted bounds give nothing."""
        df = self._where(start, end)
        return df if reverse is None else self._sorted(df, reverse)

    def scan_prefix(self, prefix: bytes | str, reverse: bool | None = None) -> DataFrame:
        """Entries whose key starts with the prefix, as a range that the scan can prune by."""
        start, end = prefix_range(prefix) if isinstance(prefix, bytes) else text_prefix_range(prefix)
        return self.range(start, end, reverse)

    def take(self, n: int, start: Bound = Unbounded, end: Bound = Unbounded, reverse: bool = False, position: str | None = None) -> DataFrame:
        """The first n entries of a scan; ``position`` names a column with their place from 0."""
        df = self.range(start, end, reverse).limit(n)
        if position is None:
            return df
        order = F.col(self.key).desc() if reverse else F.col(self.key).asc()
        return df.withColumn(position, (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))  # n rows

    def enumerate(self, position: str, buckets: int | None = None) -> DataFrame:
        """All entries with their place in key order from 0, counted range by range; ranges grow in number with the entries."""
        rows = self.df.withColumn("__range", range_of(F.col(self.key), split_points(self.df, self.key, buckets)))
        below = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))  # one row a range
        firsts = counts.select("__range", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__first"))
        place = F.row_number().over(Window.partitionBy("__range").orderBy(self.key)) - 1
        return rows.withColumn("__at", place).join(F.broadcast(firsts), "__range").withColumn(position, (F.col("__at") + F.col("__first")).cast("long")).drop("__range", "__at", "__first")

    def keys(self) -> DataFrame:
        return self.df.select(self.key)

    def values(self) -> DataFrame:
        return self.iter().drop(self.key)

    # whole collections

    def len(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("len"))

    def is_empty(self) -> bool:
        return self.df.select(self.key).isEmpty()

    def checksum(self, key: Column | None = None, value: Column | None = None) -> int:
        """CRC-32 of key and value bytes, entry after entry in key order."""
        k = F.col(self.key) if key is None else key
        v = F.col("value") if value is None else value
        return checksum(self.df.select(F.col(self.key).alias("at"), k.cast("binary").alias("key"), v.cast("binary").alias("value")), "at")

    def duplicates(self) -> DataFrame:
        """Keys that occur more than once; none in a valid collection."""
        return self.df.groupBy(self.key).agg(F.count("*").alias("n")).where("n > 1")
