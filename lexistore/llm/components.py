"""Connected components of a link table, as Spark joins over written tables that shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(x, label) for every node of ``links`` (x, y): the least node of its component.

    Each round every node points to its least neighbour, pointers are followed four steps,
    and the links are contracted to what the pointers lead to; links inside a contracted
    node go.  Nodes are hashes, so their order is random, pointers are short and a round
    leaves a fraction of the links.  Every table is written before it is joined: a hot
    node is then a skewed join of two plain shuffles, which Spark splits.
    """
    turned = links.select(F.col("y").alias("x"), F.col("x").alias("y"))
    edges = scratch.write(links.select("x", "y").unionByName(turned).where("x <> y").distinct(), f"{name}-edges-0")
    hooks: list[DataFrame] = []
    while True:
        step = len(hooks)
        hook = scratch.write(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")), f"{name}-near-{step}")
        for jump in ("once", "twice"):
            after = hook.select(F.col("x").alias("to"), F.col("to").alias("far"))
            hook = scratch.write(hook.join(after, "to").select("x", F.col("far").alias("to")), f"{name}-{jump}-{step}")
        hooks.append(hook)
        ends = edges.join(hook.select("x", F.col("to").alias("fx")), "x").join(hook.select(F.col("x").alias("y"), F.col("to").alias("fy")), "y")
        edges = scratch.write(ends.where("fx <> fy").select(F.col("fx").alias("x"), F.col("fy").alias("y")).distinct(), f"{name}-edges-{step + 1}")
        for done in ("edges", "near", "once"):
            scratch.drop(f"{name}-{done}-{step}")
        if edges.isEmpty():
            break
    # from the last round, whose pointers are final, back to the first: each round's nodes are looked at once
    labels = hooks.pop().withColumnRenamed("to", "label")
    while hooks:
        further = labels.select(F.col("x").alias("to"), "label")
        labels = hooks.pop().join(further, "to", "left").select("x", F.coalesce("label", "to").alias("label"))
        labels = scratch.write(labels, f"{name}-labels-{len(hooks)}")
        scratch.drop(f"{name}-twice-{len(hooks) + 1}")
        scratch.drop(f"{name}-labels-{len(hooks) + 1}")
    return labels
