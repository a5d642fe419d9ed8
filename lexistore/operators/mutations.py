"""Replay of mutation logs: upserts, deletes, compare-and-swap, read-modify-write, batches.

A log has a key, a total order ``seq`` (a unique integer) and what each operation does.
State never depends on how rows are partitioned.  Running results over a key are computed in
slices of ``seq``: a window (or fold) inside each slice, and one carried row for each key and
slice, so a key with a large part of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

SLICE = 16_384  # operations in a slice of the order, and so at most in one group


def _slice(seq: str, width: int) -> Column:
    return F.floor(F.col(seq) / width).cast("long")


def by_shuffle(side: DataFrame) -> DataFrame:
    """Marks a side of a join that grows with a collection to meet the other one by a shuffle at every size.

    Files of sorted keys are many times smaller than their rows, so an estimate by their size would
    send a whole collection through the driver to every executor.
    """
    return side.hint("merge")


def latest(log: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Last write wins: key and the columns of its last operation (partial aggregation first)."""
    last = F.max_by(F.struct(*columns), F.col(seq)).alias("__last")
    return log.groupBy(key).agg(last).select(key, "__last.*")


def replay(log: DataFrame, key: str, seq: str, columns: list[str], deletes: Column) -> DataFrame:
    """Snapshot of a log of upserts and deletes: the last operation decides, deleted keys are absent."""
    marked = log.withColumn("__gone", deletes)
    return latest(marked, key, seq, [*columns, "__gone"]).where("not __gone").drop("__gone")


def previous(log: DataFrame, key: str, seq: str, value: Column, name: str = "previous", width: int = SLICE) -> DataFrame:
    """Each operation with the value that the operation before it on the same key left (null for none).

    ``value`` is what an operation leaves: null for a delete.
    """
    rows = log.withColumn("__slice", _slice(seq, width)).withColumn("__left", F.struct(value.alias("v")))
    inside = Window.partitionBy(key, "__slice").orderBy(seq)
    ends = rows.groupBy(key, "__slice").agg(F.max_by("__left", seq).alias("__end"))
    carried = ends.select(key, "__slice", F.lag("__end").over(Window.partitionBy(key).orderBy("__slice")).alias("__carried"))
    out = rows.withColumn("__near", F.lag("__left").over(inside)).join(carried, [key, "__slice"], "left")
    return out.withColumn(name, F.coalesce("__near", "__carried")["v"]).drop("__slice", "__left", "__near", "__carried")


def running_count(log: DataFrame, key: str, seq: str, new: str = "new", old: str = "old", width: int = SLICE) -> DataFrame:
    """Counter per key: the value after each operation, and the value before it (null for the first)."""
    rows = log.withColumn("__slice", _slice(seq, width))
    inside = Window.partitionBy(key, "__slice").orderBy(seq)
    counts = rows.groupBy(key, "__slice").agg(F.count("*").alias("__n"))
    below = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(key, "__slice", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__carried"))
    out = rows.withColumn("__n", F.row_number().over(inside)).join(carried, [key, "__slice"])
    out = out.withColumn(new, (F.col("__n") + F.col("__carried")).cast("long"))
    return out.withColumn(old, F.when(F.col(new) > 1, F.col(new) - 1)).drop("__slice", "__n", "__carried")


def fold(log: DataFrame, key: str, seq: str, step: Callable, state: str, outcome: Callable) -> DataFrame:
    """General read-modify-write with a Column function over each key's operations in order.

    ``step(state, op)`` gives the next state (null: absent); ``outcome(state, op)`` a struct for
    the result.  The fold is serial by nature; a key's operations come in one list, so this
    is for keys of bounded length.  ``fold_rows``, ``compare_and_swap`` and the counters above have no such limit.
    """
    ops = F.array_sort(F.collect_list(F.struct(seq, *[c for c in log.columns if c not in (key, seq)])))
    rows = log.groupBy(key).agg(ops.alias("ops"))
    kind = state
    zero = F.struct(F.lit(None).cast(kind).alias("cur"), F.array().cast(f"array<{_outcome_type(rows, step, outcome, kind)}>").alias("out"))
    done = F.aggregate("ops", zero, lambda acc, op: F.struct(step(acc["cur"], op).cast(kind).alias("cur"), F.concat(acc["out"], F.array(outcome(acc["cur"], op))).alias("out")))
    return rows.select(key, done.alias("done")).select(key, F.explode("done.out").alias("r")).select(key, "r.*")


def fold_rows(log: DataFrame, key: str, seq: str, step: Callable[[Any, dict], tuple[Any, tuple]], outcome: str) -> DataFrame:
    """General read-modify-write with a Python function: key and the columns of ``outcome`` (a schema) for each operation.

    ``step(state, row)`` gives the next state and the outcome; a key starts with None.  A
    key's operations stream through one task in order, a batch at a time, so its history may
    have any length; keys are spread over tasks.
    """
    schema = f"{key} {log.schema[key].dataType.simpleString()}, {outcome}"
    arrow = _arrow(log.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = state = None
        first = True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if first or row[key] != at:
                    at, state, first = row[key], None, False
                state, told = step(state, row)
                out.append((at, *told))
            yield from _batches(out, arrow)

    return log.repartition(key).sortWithinPartitions(key, seq).mapInArrow(run, schema)


def _outcome_type(rows: DataFrame, step: Callable, outcome: Callable, kind: str) -> str:
    probe = rows.select(F.transform("ops", lambda op: outcome(F.lit(None).cast(kind), op)).alias("x"))
    return probe.schema["x"].dataType.elementType.simpleString()


def compare_and_swap(log: DataFrame, key: str, seq: str, expected: str, new: str, width: int = SLICE) -> DataFrame:
    """Outcome of each compare-and-swap: key, seq, ok, previous, proposed, current.

    ``previous`` is the value found; on failure it stays and ``current`` equals it.  Null means
    absent for ``expected`` and ``new`` alike.

    A slice of operations acts on a register as a small map: a start value that some operation
    expects leads to one end value, any other start stays.  One pass backwards over a slice
    gives its map.  The maps of a key's slices are then walked in order, a row at a time, to
    give every slice its start; then all slices are walked at the same time, each from a row
    with its start that sorts before its operations.
    """
    kind = log.schema[new].dataType.simpleString()
    at = log.schema[key].dataType.simpleString()
    rows = log.select(F.col(key).alias("k"), _slice(seq, width).alias("slice"), F.col(seq).cast("long").alias("seq"), F.col(expected).cast(kind).alias("e"), F.col(new).alias("n"))
    places = ["k", "slice"]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = part = None
        end: dict = {}  # start value -> end value over the operations from here on; a slice comes from its last one to its first
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for xk, xpart, e, n in _rows(batch, "k", "slice", "e", "n"):
                if xpart != part or xk != k:
                    _extend(out, [k] * len(end), [part] * len(end), end.keys(), end.values())
                    k, part, end = xk, xpart, {}
                end[e] = end.get(n, n)
            yield from _columns(out, mapped)
        yield from _columns([[k] * len(end), [part] * len(end), list(end.keys()), list(end.values())], mapped)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = part = cur = None
        first = True
        done = False  # whether this slice's step was taken
        for batch in batches:
            out: list[list] = [[], [], []]
            for xk, xpart, start, end in _rows(batch, "k", "slice", "start", "end"):
                if first or xk != k or xpart != part:
                    cur = cur if not first and xk == k else None
                    k, part, first, done = xk, xpart, False, False
                    _extend(out, (k,), (part,), (cur,))
                if not done and start == cur:
                    cur, done = end, True
            yield from _columns(out, begun)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur = None
        for batch in batches:
            ok, before, after = [], [], []
            for op, e, n in _rows(batch, "op", "e", "n"):
                before.append(cur)
                ok.append(hit := e == cur)
                if not op:
                    cur = e  # the start of a slice
                elif hit:
                    cur = n
                after.append(cur)
            ops = batch.column("op")
            out = [batch.column("k"), batch.column("seq"), ok, before, batch.column("n"), after]
            yield from _columns([(c if isinstance(c, pa.Array) else pa.array(c, f.type)).filter(ops) for c, f in zip(out, told, strict=True)], told)

    mapped = _arrow(log.sparkSession, f"k {at}, slice long, start {kind}, end {kind}")
    begun = _arrow(log.sparkSession, f"k {at}, slice long, start {kind}")
    told = _arrow(log.sparkSession, f"k {at}, seq long, ok boolean, previous {kind}, proposed {kind}, current {kind}")
    dealt = lambda df, *by: df.repartition(*by).sortWithinPartitions
    steps = dealt(rows, *places)(*places, F.desc("seq")).mapInArrow(maps, f"k {at}, slice long, start {kind}, end {kind}")
    begins = dealt(steps, "k")(*places).mapInArrow(starts, f"k {at}, slice long, start {kind}")
    begins = begins.select("k", "slice", F.lit(False).alias("op"), F.lit(None).cast("long").alias("seq"), F.col("start").alias("e"), F.lit(None).cast(kind).alias("n"))
    both = rows.select("k", "slice", F.lit(True).alias("op"), "seq", "e", "n").unionByName(begins)  # a slice's start comes before its operations
    out = dealt(both, *places)(*places, "op", "seq").mapInArrow(outcomes, f"k {at}, seq long, ok boolean, previous {kind}, proposed {kind}, current {kind}")
    return out.withColumnRenamed("k", key)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of some columns as plain tuples: a column is turned at once, and no row is a dict."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _extend(columns: list[list], *more: Iterable) -> None:
    for held, x in zip(columns, more, strict=True):
        held.extend(x)


def _columns(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays([(pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type)) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def cas_state(outcomes: DataFrame, key: str) -> DataFrame:
    """Registers after all compare-and-swaps: key and value, absent ones left out."""
    return latest(outcomes, key, "seq", ["current"]).where("current is not null").select(key, F.col("current").alias("value"))


def dedupe_batch(batch: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """One operation a key: the last one in the batch."""
    return latest(batch, key, seq, columns)


def overlay(snapshot: DataFrame, batch: DataFrame, key: str, deletes: str, shuffled: bool = False) -> DataFrame:
    """Atomic batch: a snapshot with a deduplicated batch put over it; ``deletes`` is a boolean column.

    ``shuffled``: the batch may be as large as the snapshot, whatever its estimate.
    """
    puts = batch.where(~F.col(deletes)).select(*snapshot.columns)
    keys = by_shuffle(batch.select(key)) if shuffled else batch.select(key)
    return snapshot.join(keys, key, "left_anti").unionByName(puts)


def batch_get(probes: DataFrame, batch: DataFrame, key: str, deletes: str, status: str = "status") -> DataFrame:
    """Tri-state lookup in a batch: absent, delete or put."""
    found = probes.join(batch.withColumn("__in", F.lit(True)), key, "left")
    state = F.when(F.col("__in").isNull(), "absent").when(F.col(deletes), "delete").otherwise("put")
    return found.withColumn(status, state).drop("__in", deletes)


def effective(snapshot: DataFrame, batch: DataFrame, key: str, value: str, deletes: str) -> DataFrame:
    """The operations that change anything: no rewrite of an equal value, no delete of a missing key."""
    held = snapshot.select(key, F.col(value).alias("__held"), F.lit(True).alias("__in"))
    rows = batch.join(by_shuffle(held), key, "left")
    idle = F.when(F.col(deletes), F.col("__in").isNull()).otherwise(F.col("__in").isNotNull() & F.col(value).eqNullSafe(F.col("__held")))
    return rows.where(~idle).drop("__held", "__in")
