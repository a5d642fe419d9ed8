"""CRC-32 over an ordered scan, computed in parallel.

The checksum of a concatenation follows from the checksums and lengths of its parts, so
every key range is summed by itself and the ranges are combined in order on the driver
(one row a range).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POLYNOMIAL = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def combine(first: int, second: int, length: int) -> int:
    """CRC-32 of a concatenation from its parts' sums and the second part's length in bytes.

    Appending a zero bit is a linear map of the 32 bits; its powers append any number.
    """
    step = [_POLYNOMIAL, *(1 << i for i in range(31))]
    bits = 8 * length
    while bits:
        if bits & 1:
            first = _times(step, first)
        step = [_times(step, row) for row in step]
        bits >>= 1
    return first ^ second


def _bytes(entries: pa.Array) -> memoryview:
    """All bytes of a binary array, one entry after the other, without a copy."""
    _, offsets, data = entries.buffers()
    if data is None or not len(entries):
        return memoryview(b"")
    at = memoryview(offsets).cast("q" if pa.types.is_large_binary(entries.type) else "i")
    return memoryview(data)[at[entries.offset] : at[entries.offset + len(entries)]]


def checksum(entries: DataFrame, order: str) -> int:
    """Sum over ``key`` and ``value`` (binary), entry after entry in the order of a column; 0 if there are none.

    A null key or value counts as empty.  Entries that are equal in the order come by key and value.
    """
    none = F.lit(b"")
    rows = entries.select(F.col(order).alias("at"), F.coalesce("key", none).alias("key"), F.coalesce("value", none).alias("value"))
    rows = rows.repartitionByRange("at").sortWithinPartitions("at", "key", "value").select("at", F.concat("key", "value").alias("entry"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, length, first = 0, 0, None
        for batch in batches:
            if first is None and len(batch):
                first = batch.slice(0, 1).column(0)
            body = _bytes(batch.column("entry"))
            crc = zlib.crc32(body, crc)
            length += len(body)
        if first is not None:
            yield pa.RecordBatch.from_arrays([first, pa.array([crc], pa.int64()), pa.array([length], pa.int64())], ["at", "crc", "length"])

    kind = entries.schema[order].dataType.simpleString()
    parts = rows.mapInArrow(part, f"at {kind}, crc long, length long")
    total = 0
    for row in sorted(parts.collect(), key=lambda r: (r["at"] is not None, r["at"])):  # one row a partition; nulls come first
        total = combine(total, row["crc"], row["length"])
    return total
