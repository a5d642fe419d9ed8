"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet in Spark joins on shared seeds (``SEED`` words, or all
words of a shorter item).  A bitmap of fixed size of all seeds of the benchmark goes to
the tasks; of a document only the seeds that pass it are written, so most documents write
none.  An item need not ask for all its seeds: the most frequent ones, whose words make
less than ``COVERAGE`` of it, can't contaminate a document alone, so only the rarer ones
are joined.  That loses nothing and keeps boilerplate seeds from making pairs.

For each pair the longest common runs of words that overlap no earlier tile are marked,
length by length, with a running Karp-Rabin hash over the unmarked words and a comparison
of the words' own hashes.  A document is contaminated by an item if its tiles cover
``COVERAGE`` of the item's words, in whatever order the passages stand.  The items of a
document are dealt into blocks of at most about ``BLOCK_BYTES`` of text, each tiled by itself.

Words are compared in lower case, without signs at their ends.  Defined cases: null or empty
texts, and items without words, never match; repeated rows get equal results; several
items with the same id count as one with the higher coverage, those without an id as one
with a null id, which comes last; extra columns are kept and
never looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, WordHashes, by_shuffle, keyed_texts, mix, row_id_a, row_id_b, window_hashes

SEED = 5
COVERAGE = 0.8
BLOCK_BYTES = 1 << 20
MASK_BITS, SHIFT = 1 << 23, 23  # two places from different bits of a seed
ROW, ITEM = ["row_a", "row_b"], ["item_a", "item_b"]
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
HITS = "array<struct<item_id:long,coverage:double,tiles:string>>"


class TokenHashes(WordHashes):
    """Hashes of words in lower case without signs at the ends (a word of signs stays)."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "surrogatepass").lower()
        return self._kept(word, super().__missing__((_ENDS.sub("", text) or text).encode("utf-8", "surrogatepass")))

    def tokens(self, text: str | None) -> np.ndarray:
        return self.of((text or "").encode("utf-8", "surrogatepass").split())


def seeds_of(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the seeds at every place; the width is part of them."""
    h = window_hashes(tokens, width)
    return mix(h + np.uint64(width)) if len(h) else h


class Items:
    """Some items of the benchmark: their tokens, and the places of their seeds as flat arrays."""

    def __init__(self, rows: list[tuple[int | None, str]], hashes: TokenHashes | None = None):
        hashes = hashes or TokenHashes()
        self.ids = [i for i, _ in rows]
        self.tokens = [hashes.tokens(t) for _, t in rows]
        by_width: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for at, tokens in enumerate(self.tokens):
            width = min(SEED, len(tokens))
            if width:
                h = window_hashes(tokens, width)
                by_width[width].append((h, np.full(len(h), at, np.int32), np.arange(len(h), dtype=np.int32)))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # width -> hash (sorted), item, place
        for width, parts in by_width.items():
            h, item, place = map(np.concatenate, zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[width] = h[order], item[order], place[order]

    def _near(self, tokens: np.ndarray, coverage: float) -> dict[int, list[tuple[int, int, int]]]:
        """For the items that seeds could cover enough of: a place in the item (of one of its seeds), each place in the document, the width.

        Whether they could is decided on the seeds alone, and every place of the document is listed once.
        """
        met: dict[int, list[tuple[int, int, int]]] = {}
        for width, (seeds, items, places) in self.seeds.items():
            h = window_hashes(tokens, width)
            near = np.flatnonzero(np.isin(h, seeds))
            if not len(near):
                continue
            at = np.flatnonzero(np.isin(seeds, h[near]))
            order = np.argsort(items[at], kind="stable")
            at = at[order]
            cuts = np.flatnonzero(np.diff(items[at])) + 1
            for own in np.split(at, cuts):
                item = int(items[own[0]])
                reached = np.zeros(len(self.tokens[item]), bool)
                for shift in range(width):
                    reached[places[own] + shift] = True
                if reached.sum() < coverage * len(reached):
                    continue
                place_of = dict(zip(seeds[own].tolist(), places[own].tolist(), strict=True))
                here = near[np.isin(h[near], seeds[own])]
                met[item] = [(place_of[seed], j, width) for j, seed in zip(here.tolist(), h[here].tolist(), strict=True)]
        return met

    def hits(self, tokens: np.ndarray, coverage: float) -> list[tuple[int | None, float, str]]:
        """(item_id, covered part, tiles as item_start:doc_start:length) for one document."""
        best: dict[int | None, tuple[float, str]] = {}
        for item, seeds_met in self._near(tokens, coverage).items():
            test = self.tokens[item]
            tiles = tile(test, tokens, seeds_met)
            part = sum(n for _, _, n in tiles) / len(test)
            if part >= coverage and part > best.get(self.ids[item], (0.0, ""))[0]:
                best[self.ids[item]] = part, ",".join(f"{i}:{j}:{n}" for i, j, n in tiles)
        return [(i, *best[i]) for i in sorted(best, key=_null_last)]


def tile(test: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (test start, doc start, length) tiles, by their place in the test.

    Only stretches of the document around seeds are searched: every tile holds a seed.
    """
    width = seeds[0][2]
    keep = np.zeros(len(doc) + 1, np.int64)
    for _, j, _ in seeds:
        keep[max(0, j - len(test))] += 1
        keep[min(len(doc), j + len(test))] -= 1
    places = np.flatnonzero(np.cumsum(keep)[:-1] > 0)
    text = doc[places]
    joined = np.ones(len(places), bool)  # whether a place follows its predecessor in the document
    joined[1:] = np.diff(places) == 1
    free_test, free_doc = np.ones(len(test), bool), np.ones(len(text), bool)
    tiles = []
    common = partial(_common, test, text, joined, free_test, free_doc)
    most = len(test)
    while most >= width:
        # a common run holds common runs of every smaller length, so bisection finds the longest
        low, high = width - 1, most
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if len(common(half)[0]) else (low, half - 1)
        if low < width:
            break
        tiles += [(i, int(places[j]), low) for i, j in _marked(test, text, free_test, free_doc, low, *common(low))]
        most = low - 1
    return sorted(tiles)


def _common(test: np.ndarray, text: np.ndarray, joined: np.ndarray, free_test: np.ndarray, free_doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Free runs of this length that both have by hash: starts in the test and their hashes, in the text and theirs."""
    starts, others = _whole(free_test, None, length), _whole(free_doc, joined, length)
    if not len(starts) or not len(others):
        return starts[:0], np.empty(0, np.uint64), others[:0], np.empty(0, np.uint64)
    of_test, of_doc = window_hashes(test, length)[starts], window_hashes(text, length)[others]
    here, there = np.isin(of_test, of_doc), np.isin(of_doc, of_test)
    return starts[here], of_test[here], others[there], of_doc[there]


def _marked(test: np.ndarray, text: np.ndarray, free_test: np.ndarray, free_doc: np.ndarray, length: int, starts: np.ndarray, of_test: np.ndarray, others: np.ndarray, of_doc: np.ndarray) -> list[tuple[int, int]]:
    """Marks the common runs of just this length, leftmost in the test first."""
    waiting = defaultdict(list)
    for j, h in zip(others.tolist()[::-1], of_doc.tolist()[::-1], strict=True):
        waiting[h].append(j)
    out = []
    for i, h in zip(starts.tolist(), of_test.tolist(), strict=True):
        if not free_test[i : i + length].all():
            continue
        places = waiting[h]
        while places and not free_doc[places[-1] : places[-1] + length].all():
            places.pop()  # what is marked stays marked
        for j in reversed(places):
            if free_doc[j : j + length].all() and (text[j : j + length] == test[i : i + length]).all():
                free_test[i : i + length] = False
                free_doc[j : j + length] = False
                out.append((i, j))
                break
    return out


def _whole(free: np.ndarray, joined: np.ndarray | None, length: int) -> np.ndarray:
    """Starts of runs of free, adjoining places."""
    n = len(free) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(~free)])
    ok = bad[length:] == bad[:n]
    if joined is not None and length > 1:
        gaps = np.concatenate([[0], np.cumsum(~joined)])
        ok &= gaps[length:] == gaps[1 : n + 1]
    return np.flatnonzero(ok)


def _rows(batch: pa.RecordBatch, keys: list[str], parts: list[np.ndarray], name: str) -> pa.RecordBatch:
    """A row for each value of each part, with the keys of the part's row."""
    take = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(values)], [*keys, name])


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item_a, item_b, width, seed), each distinct seed of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            tokens = [hashes.tokens(t) for t in batch.column("text").to_pylist()]
            widths = pa.array([min(SEED, len(t)) for t in tokens], pa.int32())
            seeds = [np.unique(seeds_of(t, min(SEED, len(t)))) if len(t) else t for t in tokens]
            yield _rows(batch.append_column("width", widths), [*ITEM, "width"], seeds, "seed")

    return items.mapInArrow(run, "item_a long, item_b long, width int, seed long")


def _mask(seeds: DataFrame) -> np.ndarray:
    """Bitmap of MASK_BITS bits, two set for each seed; its size doesn't grow with the benchmark."""
    bits = F.lit(MASK_BITS - 1).cast("long")
    places = F.explode(F.array(*[F.shiftrightunsigned("seed", SHIFT * n).bitwiseAND(bits) for n in range(2)])).alias("place")
    words = seeds.select(places).groupBy(F.shiftright("place", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("bits"))
    mask = np.zeros(MASK_BITS // 32, np.uint32)
    for word, held in words.collect():  # at most MASK_BITS / 32 rows
        mask[word] = held
    return np.unpackbits(mask.view(np.uint8), bitorder="little").astype(bool)


def _near_documents(keyed: DataFrame, widths: list[int], mask: np.ndarray) -> DataFrame:
    """row_a, row_b, seeds (distinct, those that pass the mask), text, for the documents that have any."""
    shipped = keyed.sparkSession.sparkContext.broadcast(mask)  # MASK_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = TokenHashes(), shipped.value
        for batch in batches:
            at, seeds, ends = [], [], [0]
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens = hashes.tokens(text)
                own = np.concatenate([np.empty(0, np.uint64), *(seeds_of(tokens, w) for w in widths)])
                for n in range(2):
                    own = own[held[((own >> np.uint64(SHIFT * n)) & np.uint64(MASK_BITS - 1)).astype(np.int64)]]
                if len(own):
                    at.append(i)
                    seeds.append(np.unique(own))
                    ends.append(ends[-1] + len(seeds[-1]))
            take = pa.array(at, pa.int64())
            flat = np.concatenate(seeds).view(np.int64) if seeds else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ROW), lists, batch.column("text").take(take)], [*ROW, "seeds", "text"])

    return keyed.mapInArrow(run, "row_a long, row_b long, seeds array<long>, text string")


def asked_seeds(tokens: np.ndarray, documents_of: dict[int, int], coverage: float) -> list[int]:
    """The seeds of an item, of those in ``documents_of``, that a contaminated document must have one of.

    The most frequent seeds are left out as long as all their words make less than ``coverage``.
    """
    width = min(SEED, len(tokens))
    places = defaultdict(list)
    for place, seed in enumerate(seeds_of(tokens, width).view(np.int64).tolist()):
        places[seed].append(place)
    order = sorted(documents_of, key=lambda seed: (-documents_of[seed], seed))
    reached = np.zeros(len(tokens), bool)
    for n, seed in enumerate(order):
        for place in places[seed]:
            reached[place : place + width] = True
        if reached.sum() >= coverage * len(tokens):
            return order[n:]
    return []  # all its seeds that any document has are not enough


def _asked(items: DataFrame, coverage: float) -> DataFrame:
    """(item_a, item_b, seed) from items with ``known``: their seeds and the number of documents that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            parts = []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True):
                parts.append(np.array(asked_seeds(hashes.tokens(text), {k["seed"]: k["n"] for k in known}, coverage), np.int64))
            yield _rows(batch, ITEM, parts, "seed")

    return items.mapInArrow(run, "item_a long, item_b long, seed long")


def _tiled(met: DataFrame, coverage: float) -> DataFrame:
    """(row_a, row_b, item_id, coverage, tiles) of documents with ``items``, a block of their items with a seed in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            at, hits = [], []
            for i, (text, items) in enumerate(zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                found = Items([(x["item_id"], x["text"]) for x in items], hashes).hits(hashes.tokens(text), coverage)
                at += [i] * len(found)
                hits += found
            take = pa.array(at, pa.int64())
            ids, parts, tiles = zip(*hits, strict=True) if hits else ((), (), ())
            columns = [*(batch.column(c).take(take) for c in ROW), pa.array(ids, pa.int64()), pa.array(parts, pa.float64()), pa.array(tiles, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*ROW, "item_id", "coverage", "tiles"])

    return met.mapInArrow(run, "row_a long, row_b long, item_id long, coverage double, tiles string")


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, hits): each row of ``docs`` as a struct, and the items that contaminate it."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    named = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text is not null")
    items = named.select(row_id_a().alias("item_a"), row_id_b().alias("item_b"), F.col("doc_id").alias("item_id"), "text").dropDuplicates(ITEM)
    items = scratch.write(items, "items")
    seeds = scratch.write(_item_seeds(items), "item-seeds")
    widths = sorted(w for (w,) in seeds.select("width").distinct().collect())  # SEED at most
    near = scratch.write(_near_documents(keyed_texts(docs), widths, _mask(seeds)), "near")
    met = scratch.write(near.select(*ROW, F.explode("seeds").alias("seed")), "seeds")
    known = scratch.write(met.groupBy("seed").agg(F.count("*").alias("n")).join(seeds.select(*ITEM, "seed"), "seed"), "known")
    known = known.groupBy(*ITEM).agg(F.collect_list(F.struct("seed", "n")).alias("known"))  # at most an item's seeds
    asked = scratch.write(_asked(items.join(known, ITEM), coverage), "asked")
    # both sides are written tables, so Spark can split a seed that very many documents have
    pairs = scratch.write(met.join(by_shuffle(asked), "seed").select(*ROW, *ITEM).distinct(), "pairs")
    of_row = Window.partitionBy(*ROW).orderBy(*ITEM).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = pairs.join(items, ITEM).withColumn("block", F.floor(F.sum(F.octet_length("text")).over(of_row) / block_bytes))
    blocks = sized.groupBy(*ROW, "block").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    met = near.select(*ROW, "text").join(by_shuffle(blocks), ROW).dropDuplicates([*ROW, "block"])
    hits = scratch.write(_tiled(met.select(*ROW, "text", "items"), coverage), "hits")
    best = hits.groupBy(*ROW, "item_id").agg(F.max(F.struct("coverage", "tiles")).alias("best"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("item_id").isNull().alias("last"), "item_id", "best.coverage", "best.tiles")))
    best = best.groupBy(*ROW).agg(listed.alias("hits")).select(*ROW, F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["coverage"].alias("coverage"), h["tiles"].alias("tiles"))).alias("hits"))
    best = scratch.write(best, "found")
    for name in ("items", "item-seeds", "near", "seeds", "known", "asked", "pairs", "hits"):
        scratch.drop(name)
    # the struct is made after the join, so a caller that uses some columns only has only those shuffled
    keys = {f"{c} of decontaminate": key for c, key in zip(ROW, (row_id_a(), row_id_b()), strict=True)}
    best = best.select(*[F.col(c).alias(k) for c, k in zip(ROW, keys, strict=True)], F.col("hits").alias("hits of decontaminate"))
    out = docs.withColumns(keys).join(by_shuffle(best), list(keys), "left")
    return out.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce("hits of decontaminate", F.array().cast(HITS)).alias("hits"))


def _null_last(item_id: int | None) -> tuple[bool, int]:
    return item_id is None, item_id or 0
