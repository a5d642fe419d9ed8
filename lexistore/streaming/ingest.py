"""Streaming ingestion: one micro-batch is one epoch; keyed counters as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexistore.sources.store import Database


def ingest(stream: DataFrame, db: Database, name: str, checkpoint: str, tree: bytes | None = None, every: str | None = None) -> StreamingQuery:
    """Commits each micro-batch of (seq, key, gone, value) as one epoch.

    The manifest notes the last batch of each stream, so a batch that is sent again after a
    crash changes nothing.  ``every`` is a processing-time trigger; without it the query
    takes what there is and ends.  A failed commit fails the query.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= db.state["streams"].get(name, -1):
            return
        db.tree(tree).apply_batch(batch)
        db.flush(stream=name, batch_id=batch_id)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counters(stream: DataFrame, key: str) -> DataFrame:
    """Update stream of (key, n): the number of rows of each key so far (output mode update)."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def registers(stream: DataFrame, key: str, seq: str, expected: str, new: str) -> DataFrame:
    """Update stream of the outcomes of compare-and-swaps: key, seq, ok, previous, proposed, current.

    A key's value is streaming state.  Operations of one micro-batch are taken in the order of ``seq``.
    """
    kind = stream.schema[new].dataType.simpleString()
    at = stream.schema[key].dataType.simpleString()

    def swap(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cur = state.get[0] if state.exists else None
        ops = pd.concat(batches).sort_values("seq")
        out = []
        for n, e, to in zip(*(ops[c].astype(object).where(ops[c].notna(), None) for c in ("seq", "e", "n")), strict=True):
            ok, held = e == cur, cur
            cur = to if ok else cur
            out.append((k[0], n, ok, held, to, cur))
        state.update((cur,))
        yield pd.DataFrame(out, columns=[key, "seq", "ok", "previous", "proposed", "current"], dtype=object)

    rows = stream.select(F.col(key), F.col(seq).cast("long").alias("seq"), F.col(expected).cast(kind).alias("e"), F.col(new).alias("n")).groupBy(key)
    told = f"{key} {at}, seq long, ok boolean, previous {kind}, proposed {kind}, current {kind}"
    return rows.applyInPandasWithState(swap, told, f"current {kind}", "update", GroupStateTimeout.NoTimeout)
