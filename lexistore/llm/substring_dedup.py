"""Substring dedup over a compacted de Bruijn graph of word k-mers.

An edge of the graph is a window of ``WINDOW`` words.  It is compacted in two steps.

First inside the texts: each window has an anchor, the least hash among its
``ANCHOR``-word pieces, and consecutive windows of a text with the same anchor form a path.
The anchor and the path's own content depend on the words alone, so equal passages
have equal paths.  Anchors that occur once can't belong to a repeated window and are gone
after the first join.  Where all paths of an anchor have the same content, or a content occurs
more than once, a path stays one unit; elsewhere the repeated windows are units, listed
once for each different content.

Then across paths, through Spark joins: successors and predecessors of every unit are
counted, and a unit that always follows one other, which it always follows alone, is joined to
it.  Chains of such nonbranching units contract to maximal runs, named by their heads: as
every occurrence of a chain is whole, a run is a head and the joined units after it.

Hashes (two of 64 bits with different bases) only propose.  Each run's words are read again at
its source coordinates (row key and word numbers), and a run is removed if it
occurs at least twice and 128 bits of SHA-256 of its words are the same at all its occurrences.

A window counts as repeated if its words start anywhere else too, also in the same
document and in overlap.  Defined cases: a null text has no words; texts of fewer words
than the window keep all; rows equal in id and text are documents of their own, so all
their windows are repeated; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, OTHER_BASE, Powers, Scratch, TextHashes, WordHashes, by_shuffle, keyed_texts, range_hashes, row_id_a, row_id_b, salted, window_hashes

WINDOW = 35
ANCHOR = 8
OTHER = 0x5BD1E995  # seed of the second hash
ROW = ["row_a", "row_b"]
PATH = ["path_a", "path_b"]
UNIT = ["kind", "a", "b"]
Hashes = Callable[[], TextHashes | WordHashes]


def anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of a text: anchor hash, first window, last window."""
    pieces = window_hashes(h, anchor)
    span = window - anchor + 1
    if len(pieces) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    # of equal hashes the leftmost counts, so the place stands in the lower half
    least = (pieces & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(pieces), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return pieces[place[first]], first, last


def covered(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any range first..end."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:-1] > 0


def _paths(keyed: DataFrame, window: int, anchor: int, make: Hashes) -> DataFrame:
    schema = "anchor long, path_a long, path_b long, row_a long, row_b long, first int, last int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, others = make(), Powers(BASE), Powers(OTHER_BASE)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                h = hashes.of_text(text.encode("utf-8", "surrogatepass"))
                a, first, last = anchors(h, window, anchor)
                if len(a):
                    own = (np.full(len(a), i), a, range_hashes(h, first, last + window, powers), range_hashes(salted(h, OTHER), first, last + window, others), first, last)
                    for part, x in zip(parts, own, strict=True):
                        part.append(x)
            at, a, x, y, first, last = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
            take = pa.array(at)
            columns = [pa.array(a.view(np.int64)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), batch.column("row_a").take(take), batch.column("row_b").take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "path_a", "path_b", "row_a", "row_b", "first", "last"])

    return keyed.mapInArrow(run, schema)


def _edges(listed: DataFrame, window: int, make: Hashes) -> DataFrame:
    """A row for each window of the listed paths (``paths``: first and last windows)."""
    schema = "edge_a long, edge_b long, row_a long, row_b long, first int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = make()
        for batch in batches:
            at, x, y, places = [], [], [], []
            paths = batch.column("paths")
            flat, cuts = paths.flatten(), np.concatenate([[0], np.cumsum(paths.value_lengths().to_numpy())])
            firsts, lasts = (flat.field(c).to_numpy() for c in ("first", "last"))
            for i, text in enumerate(batch.column("text").to_pylist()):
                h = hashes.of_text(text.encode("utf-8", "surrogatepass"))
                mine = slice(cuts[i], cuts[i + 1])
                place = np.flatnonzero(covered(firsts[mine], lasts[mine] + 1, len(h)))
                a, b = window_hashes(h, window), window_hashes(salted(h, OTHER), window, OTHER_BASE)
                at.append(np.full(len(place), i))
                x.append(a[place])
                y.append(b[place])
                places.append(place)
            at, x, y, places = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (at, x, y, places))
            take = pa.array(at)
            columns = [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), batch.column("row_a").take(take), batch.column("row_b").take(take), pa.array(places.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["edge_a", "edge_b", "row_a", "row_b", "first"])

    return listed.mapInArrow(run, schema)


def _digests(listed: DataFrame, window: int) -> DataFrame:
    """(kind, a, b, digest_a, digest_b) of every run of the listed rows (``runs``: first, last, kind, a, b): 128 bits of SHA-256 of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            runs = batch.column("runs")
            flat, sizes = runs.flatten(), runs.value_lengths().to_pylist()
            places = zip(flat.field("first").to_pylist(), flat.field("last").to_pylist(), strict=True)
            for text, n in zip(batch.column("text").to_pylist(), sizes, strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                for a, b in islice(places, n):
                    sums.append(hashlib.sha256(b" ".join(words[a : b + window])).digest()[:16])
            halves = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in UNIT), pa.array(halves[:, 0]), pa.array(halves[:, 1])], [*UNIT, "digest_a", "digest_b"])

    return listed.mapInArrow(run, "kind int, a long, b long, digest_a long, digest_b long")


def _occurrences(keyed: DataFrame, window: int, anchor: int, scratch: Scratch, hashes: Hashes) -> DataFrame:
    """row_a, row_b, first, last, kind, a, b: the occurrences of all units (kind, a, b) that occur more than once."""
    paths = scratch.write(_paths(keyed, window, anchor, hashes), "paths")
    seen = paths.groupBy("anchor").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in PATH])
    # written tables: both sides of the join are plain shuffles, so Spark can split a hot anchor
    nodes = scratch.write(seen.where("n > 1").select("anchor", F.expr("least_path_a <> most_path_a or least_path_b <> most_path_b").alias("branches")), "nodes")
    met = scratch.write(paths.join(nodes, "anchor").drop("anchor"), "met")
    scratch.tidy("paths", "nodes")
    contents = met.where("branches").groupBy(*PATH).agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "first", "last")).alias("source"))
    contents = scratch.write(contents, "contents")
    sources = contents.select("source.*").groupBy(*ROW).agg(F.collect_list(F.struct("first", "last")).alias("paths"))
    edges = scratch.write(_edges(keyed.join(by_shuffle(sources), ROW), window, hashes), "edges")
    twice = scratch.write(edges.groupBy("edge_a", "edge_b").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    unit = lambda kind, a, b: (F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    same = met.where("branches").join(contents.where("n > 1").select(*PATH), PATH)
    whole = met.where("not branches").drop("branches").unionByName(same.drop("branches")).select(*ROW, "first", "last", *unit(0, *PATH))
    single = edges.join(twice, ["edge_a", "edge_b"]).select(*ROW, "first", F.col("first").alias("last"), *unit(1, "edge_a", "edge_b"))
    found = whole.unionByName(single).repartition(*ROW, "kind").distinct()  # rows that share a key once, dealt as the next window is
    found = scratch.write(found, "occurrences")
    scratch.tidy("met", "contents", "edges", "twice")
    return found


def _runs(found: DataFrame, scratch: Scratch) -> DataFrame:
    """row_a, row_b, first, last, kind, a, b (the head): occurrences with nonbranching chains of units contracted."""
    row = Window.partitionBy(*ROW, "kind").orderBy("first")
    beside = found.select("kind", "a", "b", *[F.when(F.lead("first").over(row) == F.col("last") + 1, F.lead(c).over(row)).alias(f"next_{c}") for c in "ab"], *[F.when(F.lag("last").over(row) == F.col("first") - 1, F.lag(c).over(row)).alias(f"previous_{c}") for c in "ab"])
    near = ["next_a", "next_b", "previous_a", "previous_b"]
    degrees = beside.groupBy(*UNIT).agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in near for name, f in (("least", F.min), ("most", F.max), ("count", F.count))])
    sole = lambda side: F.expr(" and ".join(f"least_{side}_{c} = most_{side}_{c} and count_{side}_{c} = n" for c in "ab"))
    degrees = degrees.select(*UNIT, sole("next").alias("onward"), sole("previous").alias("backward"), *[F.col(f"least_{c}").alias(c) for c in near])
    degrees = scratch.write(degrees.where("onward or backward"), "degrees")
    ahead = degrees.where("onward").select("kind", "a", "b", "next_a", "next_b")
    back = degrees.where("backward").select("kind", F.col("previous_a").alias("a"), F.col("previous_b").alias("b"), F.col("a").alias("next_a"), F.col("b").alias("next_b"))
    links = scratch.write(ahead.join(back, ["kind", "a", "b", "next_a", "next_b"]), "links")
    inside = links.select("kind", F.col("next_a").alias("a"), F.col("next_b").alias("b"), F.lit(True).alias("inside"))
    placed = found.join(by_shuffle(inside), UNIT, "left").withColumn("head", F.col("inside").isNull())
    # every occurrence of a chain begins with its head and is whole, so a run is a head and what follows it
    ordered = Window.partitionBy(*ROW, "kind").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("number", F.sum(F.col("head").cast("long")).over(ordered))
    at_head = [F.max(F.when(F.col("head"), F.col(c))).alias(c) for c in "ab"]
    runs = placed.groupBy(*ROW, "kind", "number").agg(F.min("first").alias("first"), F.max("last").alias("last"), *at_head)
    runs = scratch.write(runs.select(*ROW, "first", "last", *UNIT), "runs")
    scratch.tidy("occurrences", "degrees", "links")
    return runs


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hashes: Hashes = TextHashes) -> DataFrame:
    """row_a, row_b, spans: array of (first, last) ranges of repeated windows.  ``hashes`` makes the word hashes of a task."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    keyed = keyed_texts(docs)
    runs = _runs(_occurrences(keyed, window, anchor, scratch, hashes), scratch)
    listed = runs.groupBy(*ROW).agg(F.collect_list(F.struct("first", "last", *UNIT)).alias("runs"))
    digests = _digests(keyed.join(by_shuffle(listed), ROW).select("text", "runs"), window)
    proven = digests.groupBy(*UNIT).agg(F.count("*").alias("n"), *[f(f"digest_{c}").alias(f"{name}_{c}") for c in "ab" for name, f in (("least", F.min), ("most", F.max))])
    # only clashes of hashes fail, so this table is all but empty; Spark looks at its size before it chooses a join
    failed = scratch.write(proven.where("not (n > 1 and least_a = most_a and least_b = most_b)").select(*UNIT), "failed")
    spans = runs.join(failed, UNIT, "left_anti").groupBy(*ROW).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = scratch.write(spans, "spans")
    scratch.tidy("runs", "failed")
    return spans


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the words left, by single spaces)."""
    spans = repeated_spans(docs, window, anchor)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id_a(), row_id_b(), text.alias("text"))
    rows = rows.join(by_shuffle(spans), ROW, "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_in, removed, sums, texts = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                words_in.append(len(words))
                if found:
                    first, last = (np.array([s[c] for s in found]) for c in ("first", "last"))
                    kept = [words[i] for i in np.flatnonzero(~covered(first, last + window, len(words))).tolist()]
                else:
                    kept = words
                removed.append(len(words) - len(kept))
                body = b" ".join(kept)
                sums.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    texts.append(body.decode("utf-8", "surrogatepass"))
            columns = [batch.column("doc_id"), pa.array(words_in, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
