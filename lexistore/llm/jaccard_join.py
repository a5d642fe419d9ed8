"""N-gram Jaccard self-join with signature trees.

Each document's set of word shingles is hashed to 64 bits.  Equal sets form a class and one
of them stands for it.  In the common random order of the hashes two sets of Jaccard
similarity t or more share one of their first tokens: certainly one of the first
n - ceil(t n) + 1, and one of the first ``m`` but for a chance of 2 (1 - t)**m, with ``m``
chosen to make that less than 2**-64, the chance that two shingles share a hash.  The
shorter of the two prefixes is used; with ``exact`` it is always the first of them.

Classes that share a prefix token meet in a group.  A group is a signature tree over its
members in order of size: nodes hold OR-combined token bitmaps, size ranges and the slack
that the bitmaps can't see; a dual traversal drops pairs of nodes whose largest possible
overlap is too small, and pairs of nodes already in one component.  Bitmaps grow
with the sets, so large sets are told apart as well as small ones.  Tokens with the same
members (by number and a 128-bit sum of the members' own hashes) make one group.

Two rounds: the first emits a spanning forest of each group's possible links, verifies them
on the texts and joins the components they give.  The second finds in each group the parts
that possible links between different components hold together, brings the whole sets of
their members, made anew from the texts, and emits a spanning forest of each part's
verified links.  A pair belongs to the group of the least token that its prefixes share and
is looked at in no other.  No link between different components is left out, and a group
emits no more rows than the members dealt to it, once for each two chunks of a part that is
cut: a large group of near copies never makes all its pairs.

No task holds a whole hot group.  In the first round a group of more than ``BLOCK`` members
is dealt into blocks of which each meets the next one, so a member is sent twice at most.
Before the second round a group whose members are all in one component is gone.  What is
left of a hot group is dealt by size first: only blocks whose sizes may link meet.  Parts
whose sets hold more than ``PART_TOKENS`` shingles are cut in the same way.

Defined cases: a text without words, or null, has no shingles and no links and is its own
component; fewer words than the shingle width make one shingle; null ids never label a
component that holds another id; rows equal in id and text are in one component; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, by_shuffle, keyed_texts, mix, row_id_a, row_id_b, salted, window_hashes
from .components import components

LEAST_BITS, MOST_BITS = 2048, 1 << 17
BLOCK = 2048
BANDED = 1 << 32  # blocks that a band of sizes may have
PART_TOKENS = 1 << 22  # shingles that a chunk of a part may have, besides its largest member's
LEAF, FANOUT = 32, 8
ROW = ["row_a", "row_b"]
NODE = "struct<a:long,b:long>"
GROUP = ["token", "i", "j"]
PART = [*GROUP, "p", "q"]


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    h = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return h
    if len(h) < width:
        return salted(window_hashes(h, len(h)), len(h))
    return np.unique(window_hashes(h, width))


def prefix_length(n: int, percent: int, exact: bool = False) -> int:
    sure = n - -(-percent * n // 100) + 1
    return sure if exact else min(sure, math.ceil(65 / math.log2(1 / (1 - percent / 100))))


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= percent * (len(s) + len(t) - common)


def signature(s: np.ndarray) -> tuple[bytes, int]:
    """Token bitmap with at least four bits a token (a power of two), and the tokens it can't tell apart."""
    size = LEAST_BITS
    while size < 4 * len(s) and size < MOST_BITS:
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[(mix(s) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes(), len(s) - int(bits.sum())


def _sets(docs: DataFrame, width: int, percent: int, exact: bool) -> DataFrame:
    schema = "row_a long, row_b long, doc_id long, n long, key_a long, key_b long, bits binary, slack int, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, a, b, bits, slacks, tokens, ends = [], [], [], [], [], [], [0]
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width, hashes)
                sig, slack = signature(s)
                first = s[: prefix_length(len(s), percent, exact)] if len(s) else s
                n.append(len(s))
                with np.errstate(over="ignore"):
                    a.append(mix(s).sum(dtype=np.uint64))
                    b.append(salted(s, 77).sum(dtype=np.uint64))
                bits.append(sig)
                slacks.append(slack)
                tokens.append(first)
                ends.append(ends[-1] + len(first))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            columns = [batch.column("row_a"), batch.column("row_b"), batch.column("doc_id"), pa.array(n, pa.int64()), *longs, pa.array(bits, pa.binary()), pa.array(slacks, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return docs.mapInArrow(run, schema)


class Node:
    """Part of a tree: members a..b of a size class, or nodes below."""

    __slots__ = ("a", "b", "least", "most", "bits", "slack", "below")

    def __init__(self, a: int, b: int, least: int, most: int, bits: np.ndarray, slack: int, below: list[Node]):
        self.a, self.b, self.least, self.most, self.bits, self.slack, self.below = a, b, least, most, bits, slack, below


class SizeClass:
    """Members whose bitmaps have the same length, in order of size, under one root."""

    def __init__(self, at: np.ndarray, n: np.ndarray, bits: np.ndarray, slack: np.ndarray):
        self.at, self.n, self.bits, self.slack = at, n, bits, slack
        self.folded = fold(bits)
        nodes = []
        for a in range(0, len(at), LEAF):
            b = min(a + LEAF, len(at))
            nodes.append(Node(a, b, int(n[a]), int(n[b - 1]), np.bitwise_or.reduce(bits[a:b]), int(slack[a:b].max()), []))
        while len(nodes) > 1:
            parts = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
            nodes = [Node(p[0].a, p[-1].b, p[0].least, p[-1].most, np.bitwise_or.reduce([x.bits for x in p]), max(x.slack for x in p), p) for p in parts]
        self.root = nodes[0]


def fold(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the length: a token keeps the lower digits of its place."""
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


class Group:
    """Members of one group as signature trees, one for each bitmap length.

    Sets that may link differ in size by less than a factor of two, so their lengths are
    equal or next to each other; the longer bitmap is then folded.
    """

    def __init__(self, n: np.ndarray, bits: list[bytes], slack: np.ndarray, component: np.ndarray, side: np.ndarray, part: np.ndarray | None = None):
        self.component, self.side = component, side
        self.part = component.copy() if part is None else part  # what a forest has joined, at first the components
        self.cross = side.min() != side.max()  # two blocks meet: pairs within a block are another group's
        lengths = np.array(list(map(len, bits)))
        self.classes: dict[int, SizeClass] = {}
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            at = at[np.argsort(n[at], kind="stable")]
            rows = np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)
            self.classes[length] = SizeClass(at, n[at], rows, slack[at])

    def links(self, percent: int, forest: bool, accept: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
        """Pairs of members that may link and are in different components; if ``forest``, a forest of them.

        Only pairs that ``accept`` holds for count; a forest asks for those alone that would join two of its parts.
        """
        out: list[tuple[int, int]] = []
        for length, small in self.classes.items():
            self._traverse(small, small, percent, forest, accept, out)
            if 2 * length in self.classes:
                self._traverse(small, self.classes[2 * length], percent, forest, accept, out)
        return out

    def _traverse(self, s: SizeClass, t: SizeClass, percent: int, forest: bool, accept: Callable[[int, int], bool] | None, out: list[tuple[int, int]]) -> None:
        """Dual traversal; ``t`` holds the larger sets."""
        stack = [(s.root, t.root)]
        while stack:
            x, y = stack.pop()
            if x is not y:
                low, high = (x, y) if x.least <= y.least else (y, x)
                if low.most * 100 < percent * high.least:
                    continue
                least = -(-percent * (x.least + y.least) // (100 + percent))
                other, slack = (y.bits, min(x.slack, y.slack)) if s is t else (fold(y.bits), x.slack)
                if int(np.bitwise_count(x.bits & other).sum()) + slack < least:
                    continue
            if any((of[s.at[x.a : x.b]] == of[s.at[x.a]]).all() and (of[t.at[y.a : y.b]] == of[s.at[x.a]]).all() for of in (self.component, self.part)):
                continue
            if not x.below and not y.below:
                self._leaves(s, t, x, y, percent, forest, accept, out)
            elif x is y:
                stack += [(p, q) for i, p in enumerate(x.below) for q in x.below[i:]]
            else:
                stack += [(p, q) for p in x.below or [x] for q in y.below or [y]]

    def _leaves(self, s: SizeClass, t: SizeClass, x: Node, y: Node, percent: int, forest: bool, accept: Callable[[int, int], bool] | None, out: list[tuple[int, int]]) -> None:
        a, b = slice(x.a, x.b), slice(y.a, y.b)
        at, to = s.at[a], t.at[b]
        nx, ny = s.n[a][:, None], t.n[b][None]
        other = t.bits if s is t else t.folded
        common = np.bitwise_count(s.bits[a][:, None, :] & other[b][None]).sum(axis=2, dtype=np.int64)
        slack = np.minimum(s.slack[a][:, None], t.slack[b][None]) if s is t else s.slack[a][:, None]
        ok = (common + slack) * (100 + percent) >= percent * (nx + ny)
        ok &= np.minimum(nx, ny) * 100 >= percent * np.maximum(nx, ny)
        for of in (self.component, self.part):
            ok &= of[at][:, None] != of[to][None]
        if x is y:
            ok &= np.arange(len(at))[:, None] < np.arange(len(to))[None]
        if self.cross:
            ok &= self.side[at][:, None] != self.side[to][None]
        for i, j in zip(*np.nonzero(ok), strict=True):
            i, j = int(at[i]), int(to[j])
            if forest and self.part[i] == self.part[j] or accept and not accept(i, j):
                continue
            if forest:
                self.part[self.part == self.part[j]] = self.part[i]
            out.append((i, j))


def _each(rows: DataFrame, keys: list[str], solve: Callable[[pa.Table], np.ndarray], names: list[str]) -> DataFrame:
    """The rows of longs that ``solve`` gives for the rows of every group."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            groups = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1).tolist(), len(groups)]
            out: list[np.ndarray] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(a, b - a)
                if held and _group_of(held[0]) != tuple(groups[a].tolist()):
                    out += solved(held)
                    held = []
                held.append(piece)
            yield packed(out)
        if held:
            yield packed(solved(held))

    def _group_of(batch: pa.RecordBatch) -> tuple[int, ...]:
        return tuple(batch.column(c)[0].as_py() for c in keys)

    def solved(held: list[pa.RecordBatch]) -> list[np.ndarray]:
        t = pa.Table.from_batches(held)
        return [solve(t)] if len(t) > 1 else []

    def packed(out: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate([np.empty((0, len(names)), np.int64), *out])
        return pa.RecordBatch.from_arrays([pa.array(values[:, c]) for c in range(len(names))], names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _columns(t: pa.Table, *names: str) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in names], axis=1)


def _components_of(t: pa.Table) -> np.ndarray:
    return np.unique(_columns(t, "component_a", "component_b"), axis=0, return_inverse=True)[1].ravel()


def _arrays_of(t: pa.Table, name: str) -> Callable[[int], np.ndarray]:
    """The list of longs in a row."""
    column = t.column(name).combine_chunks()
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return lambda i: values[ends[i] : ends[i + 1]]


def _owned(earlier: Callable[[int], np.ndarray]) -> Callable[[int, int], bool]:
    """Whether two members share none of the prefix tokens ``earlier`` than their group's."""
    known: dict[int, frozenset[int]] = {}
    size = 0

    def of(i: int) -> frozenset[int]:
        nonlocal size
        if i not in known:
            if size > 1 << 20:
                known.clear()
                size = 0
            known[i] = frozenset(earlier(i).tolist())
            size += len(known[i]) + 8
        return known[i]

    return lambda i, j: of(i).isdisjoint(of(j))


def _nodes(pairs: DataFrame) -> DataFrame:
    node = lambda c: F.struct(F.col(f"{c}a").alias("a"), F.col(f"{c}b").alias("b")).alias(c)
    return pairs.select(node("x"), node("y"))


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """(x, y) pairs of nodes, x < y, that make a forest of each group's possible links.

    ``members`` holds token, i, j, own, node, n, bits, slack, component.
    """

    def solve(t: pa.Table) -> np.ndarray:
        n, slack, own = (t.column(c).to_numpy() for c in ("n", "slack", "own"))
        group = Group(n, t.column("bits").to_pylist(), slack, _components_of(t), own)
        node = list(map(tuple, _columns(t, "a", "b").tolist()))
        pairs = [min(node[i], node[j]) + max(node[i], node[j]) for i, j in group.links(percent, True)]
        return np.array(pairs, np.int64).reshape(-1, 4)

    return _nodes(_each(members, GROUP, solve, ["xa", "xb", "ya", "yb"])).distinct()


def chunks(part: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(p, q, own, members) for every two chunks p <= q of a part that may hold links.

    Chunks hold members of one side, in order of size, and PART_TOKENS shingles besides the largest member's.
    """
    cross, count = side.min() != side.max(), 0
    order = np.lexsort((n, side, part))
    for same in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        cut: list[np.ndarray] = []
        for one in np.split(same, np.flatnonzero(np.diff(side[same])) + 1):
            cut += np.split(one, np.flatnonzero(np.diff(np.cumsum(n[one]) // PART_TOKENS)) + 1)
        for p, x in enumerate(cut):
            for q, y in enumerate(cut[p:], p):
                if cross and side[x[0]] == side[y[0]] or 100 * min(n[x[-1]], n[y[-1]]) < percent * max(n[x[0]], n[y[0]]):
                    continue
                yield count + p, count + q, count + p, x
                if p < q:
                    yield count + p, count + q, count + q, y
        count += len(cut)


def _parts(members: DataFrame, percent: int) -> DataFrame:
    """Members that may link, as rows of PART, own, a, b, component_a, component_b: a row for each two chunks of their part.

    ``members`` has ``earlier`` too, the prefix tokens less than the group's.
    """
    keep = [*GROUP, "a", "b", "component_a", "component_b"]

    def solve(t: pa.Table) -> np.ndarray:
        n, slack, own = (t.column(c).to_numpy() for c in ("n", "slack", "own"))
        group = Group(n, t.column("bits").to_pylist(), slack, _components_of(t), own, np.arange(len(t)))
        close = np.unique(np.array(group.links(percent, True, _owned(_arrays_of(t, "earlier"))), np.int64))
        out = [np.empty((0, len(keep) + 3), np.int64)]
        if len(close):
            rows = _columns(t, *keep)[close]
            for p, q, mine, at in chunks(group.part[close], n[close], own[close], percent):
                out.append(np.concatenate([rows[at, :3], np.tile([p, q, mine], (len(at), 1)), rows[at, 3:]], axis=1))
        return np.concatenate(out)

    return _each(members, GROUP, solve, [*PART, "own", *keep[3:]])


def _linked(parts: DataFrame, texts: DataFrame, width: int, percent: int, exact: bool) -> DataFrame:
    """(x, y) pairs of nodes that make a forest of each part's links, by the sets made anew from the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = [shingle_set(text, width, hashes) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, made)])
            flat = np.concatenate([np.empty(0, np.uint64), *made]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), lists], ["a", "b", "tokens"])

    def solve(t: pa.Table) -> np.ndarray:
        of, token = _arrays_of(t, "tokens"), t.column("token")[0].as_py()
        held = [of(i).view(np.uint64) for i in range(len(t))]

        def earlier(i: int) -> np.ndarray:
            first = of(i)[: prefix_length(len(held[i]), percent, exact)]
            return first[first < token]

        owned = _owned(earlier)
        signed = [signature(s) for s in held]
        n, slack = np.array(list(map(len, held))), np.array([x for _, x in signed])
        group = Group(n, [b for b, _ in signed], slack, _components_of(t), t.column("own").to_numpy())
        pairs = group.links(percent, True, lambda i, j: owned(i, j) and linked(held[i], held[j], percent))
        node = _columns(t, "a", "b")
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return np.concatenate([node[at[:, 0]], node[at[:, 1]]], axis=1)

    wanted = parts.select("a", "b").distinct()
    whole = texts.select("node.a", "node.b", "text").join(by_shuffle(wanted), ["a", "b"], "left_semi").mapInArrow(sets, "a long, b long, tokens array<long>")
    return _nodes(_each(parts.join(by_shuffle(whole), ["a", "b"]), PART, solve, ["xa", "xb", "ya", "yb"]))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets, made anew from the texts, link."""
    left = by_shuffle(pairs).join(texts.select(F.col("node").alias("x"), F.col("text").alias("text_x")), "x")
    both = left.join(texts.select(F.col("node").alias("y"), F.col("text").alias("text_y")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), {}

        def of(text: str) -> np.ndarray:
            if text not in known:
                if len(known) >= 256:
                    known.clear()
                known[text] = shingle_set(text, width, hashes)
            return known[text]

        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("text_x").to_pylist(), batch.column("text_y").to_pylist(), strict=True)):
                if linked(of(a), of(b), percent):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x").take(take), batch.column("y").take(take)], ["x", "y"])

    return both.select("x", "y", "text_x", "text_y").mapInArrow(run, f"x {NODE}, y {NODE}")


def _chained(members: DataFrame) -> DataFrame:
    """Members (token, node, c) with their blocks i and j: neighbours in a ring-free row of blocks."""
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", "token"), parts).cast("int")
    last = F.greatest(parts - 2, F.lit(0))  # the last block that has one after it; a single block is by itself
    firsts = F.array_distinct(F.array(F.greatest(block - 1, F.lit(0)), F.least(block, last)))
    dealt = members.select("token", "node", F.explode(firsts).alias("i"))
    return dealt.select("token", "node", "i", (F.col("i") + 1).alias("j"), F.lit(0).alias("own"))


def _paired(members: DataFrame, percent: int) -> DataFrame:
    """Members (token, node, n, c and more) for every pair of blocks that may hold links, with their own block.

    A group of at most BLOCK members is one block.  In others a block belongs to a band of
    sizes, and sets of bands that aren't neighbours can't link.
    """
    band = F.when(F.col("c") > BLOCK, F.floor(F.log("n") / math.log(100 / percent) + 1e-9)).otherwise(0).cast("long")
    members = members.withColumn("band", band)
    counts = members.where(F.col("c") > BLOCK).groupBy("token", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    for name, shift in (("above", 1), ("below", -1)):
        members = members.join(counts.select("token", (F.col("band") - shift).alias("band"), F.col("parts").alias(name)), ["token", "band"], "left")
    members = members.join(counts, ["token", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.col("band") * BANDED + F.pmod(F.xxhash64("node", "token"), F.col("parts"))
    members = members.withColumn("own", own)

    def others(parts: Column, shift: int) -> Column:
        first = (F.col("band") + shift) * BANDED
        return F.when(parts > 0, F.sequence(first, first + parts - 1)).otherwise(F.array().cast("array<long>"))

    met = F.concat(others(F.col("parts"), 0), others(F.col("above"), 1), others(F.col("below"), -1))
    members = members.withColumn("met", F.explode(met))
    return members.withColumn("i", F.least("own", "met")).withColumn("j", F.greatest("own", "met")).drop("band", "above", "below", "parts", "met")


def jaccard_components(docs: DataFrame, width: int, percent: int, exact: bool = False) -> DataFrame:
    """row_a, row_b, doc_id, n_shingles, component_id, root: a row for each row of ``docs``.

    ``root`` tells components apart that share their least id, or have none; it is null without shingles.
    ``exact`` takes the whole prefix, about (100 - percent) % of every set, at its cost in shuffle.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    keyed = keyed_texts(docs)
    with_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with_id = keyed_rows(with_id)
    sets = scratch.write(_sets(with_id, width, percent, exact), "sets")
    node = F.struct(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    filled = sets.where("n > 0").withColumn("node", node)
    classes = filled.groupBy("node").agg(F.min(F.struct(*ROW)).alias("at"), F.min("doc_id").alias("label"))
    classes = scratch.write(classes, "classes")
    held = filled.select(*ROW, "node", "n", "bits", "slack", "tokens")
    reps = classes.select("at.*", "node").join(held, [*ROW, "node"]).dropDuplicates(["node"])
    reps = scratch.write(reps, "reps")
    named_rows = scratch.write(sets.select(*ROW, "doc_id", F.col("n").alias("n_shingles"), node.alias("node")), "rows")
    scratch.tidy("sets")

    prefix = reps.select("node", F.explode("tokens").alias("token"))
    met = prefix.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor("node.a").alias("sum_a"), F.bit_xor("node.b").alias("sum_b"))
    # tokens of the same members would make the same pairs again
    groups = scratch.write(met.where("c > 1").groupBy("c", "sum_a", "sum_b").agg(F.min("token").alias("token")).select("token", "c"), "groups")
    scratch.tidy()
    members = scratch.write(prefix.join(groups, "token"), "members")
    scratch.tidy("groups")
    rows = members.select("node").distinct().join(reps.select(*ROW, "node"), "node").select(*ROW, "node")
    texts = scratch.write(keyed.join(by_shuffle(rows), ROW).select("node", "text").dropDuplicates(["node"]), "texts")
    scratch.tidy()

    about = reps.select("node", "n", "bits", "slack")
    columns = ["token", "i", "j", "own", "node.a", "node.b", "n", "bits", "slack"]
    first = _possible(_chained(members).join(about, "node").select(*columns, F.col("node.a").alias("component_a"), F.col("node.b").alias("component_b")), percent)
    first = scratch.write(first, "pairs-1")
    scratch.tidy()
    links = scratch.write(_verified(first, texts, width, percent), "links-1")
    scratch.tidy()
    labels = components(links, scratch, "labels-1")

    placed = members.join(labels.withColumnRenamed("x", "node"), "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    placed = scratch.write(placed, "placed")
    scratch.tidy("members")
    open_groups = placed.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    placed = placed.join(open_groups, "token", "left_semi").join(reps.select("node", "n"), "node")
    placed = scratch.write(_paired(placed, percent).drop("n", "c"), "paired")
    scratch.tidy("placed")
    earlier = F.filter("tokens", lambda x: x < F.col("token")).alias("earlier")
    about = reps.select("node", "n", "bits", "slack", "tokens")
    close = _parts(placed.join(about, "node").select(*columns, earlier, F.col("component.a").alias("component_a"), F.col("component.b").alias("component_b")), percent)
    close = scratch.write(close, "close")
    scratch.tidy("paired", "reps")
    links = scratch.write(links.unionByName(_linked(close, texts, width, percent, exact)), "links-2")
    labels = components(links, scratch, "labels-2")

    named = classes.select("node", "label").join(labels.select(F.col("x").alias("node"), F.col("label").alias("root")), "node", "left")
    named = scratch.write(named.select("node", "label", F.coalesce("root", "node").alias("root")), "named")
    roots = scratch.write(named.groupBy("root").agg(F.min("label").alias("component_id")), "roots")
    named = scratch.write(named.join(roots, "root").select("node", "component_id", "root"), "components")
    scratch.tidy("classes", "texts", "pairs-1", "links-1", "close", "links-2", "named", "roots")
    out = named_rows.join(named, "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(*ROW, "doc_id", "n_shingles", own.alias("component_id"), "root")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``keyed_texts`` together with doc_id."""
    return docs.select(row_id_a(), row_id_b(), "doc_id", "text")
