"""Sharding by a hierarchical weighted hash tree (native expressions only).

A row descends region -> rack -> shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` a hash of (key, child name) and the smallest draw wins, so
a child gets a part of the rows in proportion to its weight.  A draw depends on that
child alone: if a weight grows, rows only move into that child; if it shrinks, rows only
leave it; a subtree whose weights stay keeps its inner placement.

``tree_of(count)`` is the tree of a shard count: up to ``base`` shards fill racks and
regions, and every shard beyond it hangs in a region of its own.  No weight that was there
before changes by that, so from ``base`` on one more shard takes rows only into itself
(law ``key``): the key and the count decide, not the order in which shards came.

Defined cases: a null text has 0 bytes, a null doc_id is a key of its own (all such rows
share a shard), repeated rows get the same shard and different slots, an empty table gives
no rows.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]

BASE_SHARDS = 24
COPIES = 4096  # equal rows that one step lists at once


def topology(shards: int, racks_per_region: int = 3, shards_per_rack: int = 2) -> Tree:
    """Shards 0 .. shards-1 of weight 1, filled region by region."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // shards_per_rack
        region = rack // racks_per_region
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {shard: weight}}}


def tree_of(count: int, base: int = BASE_SHARDS) -> Tree:
    """The tree of ``count`` shards; equal for everyone who has the same count and base."""
    tree = topology(min(count, base))
    for shard in range(base, count):
        tree = grow(tree, shard)
    return tree


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _children(named: list[tuple[str, float, int]]) -> Column:
    live = [x for x in named if x[1] > 0]
    if not live:
        raise ValueError("no child with a positive weight")
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(at).alias("at")) for name, weight, at in live])


def _pick(key: Column, children: Column) -> Column:
    """``at`` of the child with the least draw -ln(u)/weight; ties to the smaller ``at``.

    u is in (0, 1], made of the upper 52 bits of xxhash64 (exact in a double).
    """

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit("/"), child["name"])), 12).cast("double")
        return F.struct((-F.log((bits + F.lit(1.0)) / F.lit(float(2**52))) / child["weight"]).alias("draw"), child["at"].alias("at"))

    return F.array_min(F.transform(children, draw))["at"]


def assign(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Adds ``<prefix>region``, ``<prefix>rack`` and ``<prefix>shard``.

    Each level draws among the children of the node chosen above it and no others.
    """
    regions = list(tree)
    racks = [(r, k) for r in regions for k in tree[r]]
    shards = [(r, k, s) for r, k in racks for s in tree[r][k]]
    top = _children([(r, _weight(tree[r]), i) for i, r in enumerate(regions)])
    of_region = F.array(*[_children([(k, _weight(tree[r][k]), i) for i, (q, k) in enumerate(racks) if q == r]) for r in regions])
    of_rack = F.array(*[_children([(f"shard{s}", tree[r][k][s], s) for q, m, s in shards if (q, m) == (r, k)]) for r, k in racks])
    region = _pick(key, top)
    rack = _pick(key, F.element_at(of_region, region + 1))
    chosen = df.withColumn("rack at", rack)
    names = F.array(*[F.lit(r) for r, _ in racks]), F.array(*[F.lit(k) for _, k in racks])
    chosen = chosen.withColumn(f"{prefix}shard", _pick(key, F.element_at(of_rack, F.col("rack at") + 1)).cast("int"))
    return chosen.withColumns({f"{prefix}region": F.element_at(names[0], F.col("rack at") + 1), f"{prefix}rack": F.element_at(names[1], F.col("rack at") + 1)}).drop("rack at")


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, buckets: int = 512) -> DataFrame:
    """Each document's shard, its slot in it, and its shard in the ``grown`` tree (null without one).

    Rows equal in id, size and checksum are counted first and listed again at the end, so
    many copies are never sorted.  Each shard's rows are dealt into ``buckets`` buckets by
    a hash of the row; a table of shards x buckets counts (bounded by these two parameters)
    gives each bucket's first slot, so no task ever sorts a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    own = ["doc_id", "size", "text_crc32"]
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(rows.groupBy(*own).agg(F.count("*").alias("copies")), "rows")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = assign(rows, key, tree)
    rows = assign(rows, key, grown, "grown_") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int"))
    below = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("first_slot"))
    before = Window.partitionBy("shard", "bucket").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(firsts), ["shard", "bucket"])
    placed = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    placed = placed.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "copies") - 1)))
    return placed.select(
        *own, F.lit("key").alias("law"), "shard",
        (F.col("first_slot") + F.col("before") + F.col("copy")).cast("long").alias("slot"), "grown_shard", "region", "rack",
    )
