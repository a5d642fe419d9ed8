"""Bulk strict neighbour lookup: for each probe the nearest entry below or above.

Keys of probes and entries are cut into key ranges by split points.  Inside a range a window
carries the last entry's key seen; what lies in lower ranges is one key a range, so the rest
is a join with a table as long as the number of ranges.  Ranges grow in number with the
entries, so no window holds more than a bounded share, and only keys are shuffled into
them: entries are joined to the keys that were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_ROWS = 1 << 21  # keys in a range, about
_SAMPLE = 50  # keys sampled for each range; they only balance the ranges
_GROUP = 64  # split points that are compared at once


def split_points(df: DataFrame, key: str, buckets: int | None = None) -> list:
    """Rising keys that cut ``df`` into ``buckets`` ranges of about equal size, by default as many as its size asks for."""
    n = df.count()
    if buckets is None:
        buckets = max(min(n // 1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // RANGE_ROWS))
    if buckets < 2 or n < 2:
        return []
    rows = df.select(key).where(F.col(key).isNotNull())
    part = rows if n <= _SAMPLE * buckets else rows.sample(min(1.0, _SAMPLE * buckets / n), seed=7)
    keys = sorted(r[0] for r in part.limit(4 * _SAMPLE * buckets).collect())
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []


def range_of(key: Column, splits: list) -> Column:
    """Number of split points at or below the key; first among every ``_GROUP``-th of them, then in between."""
    below = lambda points: F.size(F.filter(points, lambda s: s <= key))
    if not splits:
        return F.lit(0)
    if len(splits) <= _GROUP:
        return below(F.array(*map(F.lit, splits)))
    groups = [splits[i : i + _GROUP] for i in range(0, len(splits), _GROUP)]
    at = below(F.array(*[F.lit(g[0]) for g in groups]))
    inside = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), at)
    return F.when(at > 0, (at - 1) * _GROUP + below(inside)).otherwise(0)


def nearest_below(entries: DataFrame, key: str, probes: DataFrame, on: str, buckets: int | None = None) -> DataFrame:
    return _nearest(entries, key, probes, on, buckets, below=True)


def nearest_above(entries: DataFrame, key: str, probes: DataFrame, on: str, buckets: int | None = None) -> DataFrame:
    return _nearest(entries, key, probes, on, buckets, below=False)


def _nearest(entries: DataFrame, key: str, probes: DataFrame, on: str, buckets: int | None, below: bool) -> DataFrame:
    """``probes`` with the columns of the neighbour, null where there is none."""
    splits = split_points(entries, key, buckets)
    have = entries.select(F.col(key).alias("__k"), F.lit(1).alias("__side"), F.col(key).alias("__entry"))
    ask = probes.select(F.col(on).alias("__k")).where("__k is not null").distinct()  # a hot probe is solved once
    ask = ask.select("__k", F.lit(0).alias("__side"), F.lit(None).cast(have.schema["__entry"].dataType).alias("__entry"))
    rows = have.unionByName(ask).withColumn("__range", range_of(F.col("__k"), splits))
    # probes come before entries of the same key, so an equal entry is never its own neighbour
    order = [F.col("__k") if below else F.col("__k").desc(), F.col("__side")]
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("__near", F.last("__entry", True).over(before)).where("__side = 0")
    edge = F.max if below else F.min
    ends = have.withColumn("__range", range_of(F.col("__k"), splits)).groupBy("__range").agg(edge("__k").alias("__edge"))
    spans = entries.sparkSession.range(len(splits) + 1).select(F.col("id").cast("int").alias("__range")).join(ends, "__range", "left")
    across = Window.orderBy(F.col("__range") if below else F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("__range", F.last("__edge", True).over(across).alias("__carried"))  # one row a range
    solved = seen.join(F.broadcast(carried), "__range").select(F.col("__k").alias(on), F.coalesce("__near", "__carried").alias("__near"))
    found = entries.select(F.col(key).alias("__near"), F.struct(*[F.col(c).alias(c) for c in entries.columns]).alias("__entry"))
    out = probes.join(solved.where("__near is not null").join(found, "__near").select(on, "__entry"), on, "left")
    return out.select(*[out[c] for c in probes.columns], *[F.col(f"__entry.{c}").alias(c if c != key or key not in probes.columns else f"near_{c}") for c in entries.columns])
