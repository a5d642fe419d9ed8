"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of ``ROLL`` neighbouring lines decides where a text is cut, so a
cut depends on the lines beside it alone, not on what stands before them or where an
earlier chunk ended: lines that are put in or taken out move no cut further on.  A chunk of
several lines that occurs more than once in the corpus is removed but for the first
occurrence (least doc_id, then text key, then place).

A repeated run that is shorter than a chunk, or begins and ends inside of two, holds no
whole chunk.  So what the chunks leave is compared once more in pieces of ``LEAST`` lines
from every line: pieces of chunks that don't repeat, of the first occurrence of
those that do, and those across a cut.  Of a run of two or more repeated lines every line
goes, wherever it stands.

Keys of 128 bits only propose: a chunk or piece is removed after its bytes were compared with
those of the first one; one that only shares the key stays.  Ranges that overlap go as one.

Defined cases: a null or empty text has no chunk that could repeat and stays as it is; rows
equal in doc_id and text are the same document, each keeps what the other keeps; a
text may become empty; an empty table gives no rows; a repeated line between lines that don't
repeat with it always stays; an empty line is a line.  The first occurrence of every line stays, but the
lines of a chunk's first occurrence may go with other chunks that repeat there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_shuffle, keyed_texts, row_id_a, row_id_b, window_hashes

LEAST = 2  # lines in a piece, and in a chunk that is compared
ROLL = 2  # lines under the rolling hash
CUTS = np.uint64(3)  # a cut where these bits of the rolling hash are 0: four lines in a chunk on average
PIECE = 1 << 16  # pieces in a record batch, about
KEY = ["key_a", "key_b"]
ROW = ["row_a", "row_b"]


def boundaries(hashes: np.ndarray) -> list[int]:
    """First lines of the chunks, and the number of lines, from the hashes of a text's lines."""
    cuts = np.flatnonzero((window_hashes(hashes, ROLL) & CUTS) == 0) + ROLL  # a cut follows the lines under the hash
    return [0, *cuts[cuts < len(hashes)].tolist(), len(hashes)]


def lines_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))


def chunks(text: str, key=xxhash.xxh3_128_digest) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first line, end line, key, bytes) of every chunk, in order."""
    lines = lines_of(text)
    cuts = boundaries(line_hashes(lines))
    for first, end in zip(cuts, cuts[1:], strict=False):
        body = b"\n".join(lines[first:end])
        yield first, end, key(body), body


def pieces(text: str, key=xxhash.xxh3_128_digest) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first line, end line, key, bytes) of the ``LEAST`` lines from every line, in order."""
    lines = lines_of(text)
    for first in range(len(lines) - LEAST + 1):
        body = b"\n".join(lines[first : first + LEAST])
        yield first, first + LEAST, key(body), body


def _chunk_rows(keyed: DataFrame, key) -> DataFrame:
    """A row for each chunk, with the keys of the pieces that begin in it."""
    schema = "row_a long, row_b long, first int, end int, key_a long, key_b long, pieces array<struct<key_a:long,key_b:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                small = [digest for _, _, digest, _ in pieces(text, key)]
                for first, end, digest, _ in chunks(text, key):
                    rows.append((i, first, end, digest, small[first:end]))
                    held += end - first
                    if held >= PIECE:
                        yield packed(batch, rows)
                        rows, held = [], 0
            yield packed(batch, rows)

    def halves(digests: list[bytes]) -> list[pa.Array]:
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return [pa.array(both[:, 0]), pa.array(both[:, 1])]

    def packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, firsts, ends, keys, inner = zip(*rows, strict=True) if rows else [()] * 5
        take = pa.array(at, pa.int64())
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in inner])]).astype(np.int32)
        values = pa.StructArray.from_arrays(halves([d for x in inner for d in x]), KEY)
        columns = [batch.column("row_a").take(take), batch.column("row_b").take(take), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()), *halves(list(keys)), pa.ListArray.from_arrays(pa.array(offsets), values)]
        return pa.RecordBatch.from_arrays(columns, [*ROW, "first", "end", *KEY, "pieces"])

    return keyed.mapInArrow(run, schema)


def _bodies(listed: DataFrame, key) -> DataFrame:
    """(row_a, row_b, first, end, key_a, key_b, body) of the line ranges ``wanted`` of each row."""
    schema = "row_a long, row_b long, first int, end int, key_a long, key_b long, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, firsts, ends, bodies = [], [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                lines = lines_of(text)
                for w in wanted:
                    at.append(i)
                    firsts.append(w["first"])
                    ends.append(w["end"])
                    bodies.append(b"\n".join(lines[w["first"] : w["end"]]))
                    if len(at) == PIECE:
                        yield packed(batch, at, firsts, ends, bodies)
                        at, firsts, ends, bodies = [], [], [], []
            yield packed(batch, at, firsts, ends, bodies)

    def packed(batch: pa.RecordBatch, at: list[int], firsts: list[int], ends: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        take, both = pa.array(at, pa.int64()), np.frombuffer(b"".join(map(key, bodies)), np.int64).reshape(-1, 2)
        columns = [batch.column("row_a").take(take), batch.column("row_b").take(take), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(bodies, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*ROW, "first", "end", *KEY, "body"])

    return listed.mapInArrow(run, schema)


def repeated_lines(docs: DataFrame, key=xxhash.xxh3_128_digest) -> DataFrame:
    """row_a, row_b, removed: sorted array of the (first, end) line ranges, apart from each other, that repeat earlier chunks cover."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    keyed = keyed_texts(docs)
    place = F.struct("row_a", "row_b", "first")
    repeated = lambda df: df.groupBy(*KEY).agg(F.min(place).alias("place"), F.max(place).alias("other")).where("place != other").select(*KEY, "place")
    # what is joined is written first: both sides are plain shuffles, so Spark can split a hot chunk
    listed = scratch.write(_chunk_rows(keyed, key), "chunks")
    groups = scratch.write(repeated(listed.where(F.col("end") - F.col("first") >= LEAST)), "chunk-groups")
    marked = scratch.write(listed.join(groups, KEY, "left"), "marked")
    scratch.tidy("chunks")
    # of a later copy of a chunk only the piece that begins at its last line is not inside it
    later = F.col("place") < place
    across = F.greatest(F.col("end") - F.col("first") - LEAST + 1, F.lit(0))
    open_pieces = F.when(later, F.slice("pieces", across + 1, LEAST)).otherwise(F.col("pieces"))
    small = marked.select(*ROW, (F.col("first") + F.when(later, across).otherwise(0)).alias("at"), F.posexplode(open_pieces).alias("pos", "piece"))
    small = small.select(*ROW, (F.col("at") + F.col("pos")).cast("int").alias("first"), "piece.*")
    piece_groups = scratch.write(repeated(small), "piece-groups")
    copies = marked.where("place is not null").select(*ROW, "first", "end").unionByName(small.join(piece_groups, KEY).select(*ROW, "first", (F.col("first") + LEAST).alias("end")))
    wanted = scratch.write(copies.groupBy(*ROW).agg(F.collect_set(F.struct("first", "end")).alias("wanted")), "wanted")
    scratch.tidy("marked")
    bodies = scratch.write(_bodies(keyed.join(by_shuffle(wanted), ROW), key), "bodies")
    firsts = groups.unionByName(piece_groups).select(*KEY, "place.*").join(bodies.select(*ROW, "first", *KEY, "body"), [*ROW, "first", *KEY])
    firsts = scratch.write(firsts.select(*KEY, place.alias("place"), F.col("body").alias("kept_body")).dropDuplicates(KEY), "firsts")
    same = bodies.join(firsts, KEY).where((F.col("body") == F.col("kept_body")) & (place != F.col("place"))).select(*ROW, "first", "end").distinct()
    removed = scratch.write(merged(same), "removed")
    scratch.tidy("chunk-groups", "piece-groups", "wanted", "bodies", "firsts")
    return removed


def merged(ranges: DataFrame) -> DataFrame:
    """row_a, row_b, removed: the (first, end) ranges of each row in order, those that overlap or touch as one."""
    before = Window.partitionBy(*ROW).orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*ROW).orderBy("first", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = ranges.withColumn("new", F.coalesce(F.col("first") > F.max("end").over(before), F.lit(True)).cast("long"))
    numbered = marked.withColumn("number", F.sum("new").over(upto))
    whole = numbered.groupBy(*ROW, "number").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return whole.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("removed"))


def without(lines: Column, removed: Column) -> Column:
    """The text of an array of lines without the given line ranges (sorted, apart from each other)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["end"]))
    ends = F.concat(F.transform(removed, lambda r: r["first"]), F.array(F.size(lines)))
    kept = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.array_join(F.flatten(kept), "\n")


def dedup_lines(docs: DataFrame, key=xxhash.xxh3_128_digest) -> DataFrame:
    """(row, text, lines, removed): each row of ``docs`` as a struct, its new text, its lines if any went, the line ranges that went."""
    removed = repeated_lines(docs, key)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_id_a(), row_id_b())
    lines = F.when(F.col("removed").isNotNull(), F.split("row.text", "\n", -1)).alias("lines")
    out = rows.join(by_shuffle(removed), ROW, "left").select("row", "removed", lines)
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(without(F.col("lines"), F.col("removed")))
    return out.select("row", text.alias("text"), "lines", "removed")
