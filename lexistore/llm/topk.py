"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are dealt into blocks by length band and hash.  Inside a block they stand in
buckets of falling length.  For each bucket a query's running k-th score gives a local
cosine threshold t = score / (|q| * longest length).  Above 1 the bucket and all later ones
are out.  A high t makes coordinate pruning pay: a vector with cosine >= t must have, on
each of the query's largest coordinates, a value in an interval around q's own.  A low t
makes length pruning the better choice: vectors shorter than score / |q| are out.  What is
left is verified with exact integer products.

A pilot of the longest vectors, at most ``PILOT``, gives every query a first threshold; a
block whose longest vector can't reach it never gets the query.  Queries go to the blocks,
each block returns its best k for each query, and the k best of these are the answer.

The table is scaled to integers once and written; the number a row gets there tells rows
apart, so rows that share an id are queries and candidates of their own.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part, nor do rows without an id, which could neither ask nor be named; every other vector
does, whatever its dimension or length; a product beyond the range of a long counts as the
end of that range, and so does a scaled component beyond that of a double; vectors of different dimension are no candidates of each other; ties go
to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

PILOT = 1024
BUCKET = 2048  # vectors in a bucket of equal treatment
BLOCK_ROWS = 32_768  # vectors or queries in a block, on average at most
LEAST_BLOCK, BLOCKS = 1024, 64  # smaller tables make smaller blocks, for about so many tasks
QUERY_ROWS = 256  # queries multiplied at once
FOCUS = 4  # coordinates that pruning looks at
COORDINATE_FROM = 0.9  # local threshold from which coordinate pruning is used
SLACK = 1e-12  # relative; more than the rounding of lengths and cosines
LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame) -> DataFrame:
    """row, vec_id, dim, norm, v (scaled components, integers as doubles), the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims, norms, packed = [], [], [], []
            for i, value in enumerate(batch.column("embedding").to_pylist()):
                if not value or None in value:
                    continue
                x = np.array(value, np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(x * 256.0), -sys.float_info.max, sys.float_info.max)
                    at.append(i)
                    dims.append(len(x))
                    norms.append(float(lengths_of(x[None])[0]))
                    packed.append(x.astype("<f8").tobytes())
            take = pa.array(at, pa.int64())
            columns = [batch.column(c).take(take) for c in ("row", "vec_id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], ["row", "vec_id", "dim", "norm", "v"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null").mapInArrow(run, "row long, vec_id long, dim int, norm double, v binary")


def lengths_of(v: np.ndarray) -> np.ndarray:
    """Lengths of rows; components are scaled first, so only lengths beyond all doubles are infinite."""
    most = np.abs(v).max(axis=1, initial=0.0)
    scale = np.where(most > 0, most, 1.0)
    with np.errstate(over="ignore"):
        return scale * np.sqrt(((v / scale[:, None]) ** 2).sum(axis=1))


def matrix(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products, cut to the range of a long.

    Doubles serve while every partial sum fits 53 bits, longs while it fits 62, else Python's integers.
    """
    with np.errstate(over="ignore"):
        most = np.abs(q).max(axis=1, initial=0) * (float(np.abs(v).max(initial=0)) * max(1, q.shape[1]))
    if (most < 2.0**53).all():
        return (q @ v.T).astype(np.int64)
    out = np.empty((len(q), len(v)), np.int64)
    small, middle = most < 2.0**53, (most >= 2.0**53) & (most < 2.0**62)
    out[small] = (q[small] @ v.T).astype(np.int64)
    out[middle] = (q[middle].astype(np.int64) @ v.astype(np.int64).T) if middle.any() else 0
    large = np.flatnonzero(most >= 2.0**62).tolist()
    others = [list(map(int, row)) for row in v.tolist()] if large else []
    for i in large:
        mine = list(map(int, q[i].tolist()))
        out[i] = [min(LONG.max, max(LONG.min, sum(map(mul, mine, row)))) for row in others]
    return out


def retrieve(q: np.ndarray, q_own: np.ndarray, floor: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, v_own: np.ndarray | None = None, made: list[int] | None = None) -> list[np.ndarray]:
    """For each query the (score, id) rows of its k best, best first; nothing below ``floor``.

    ``q_own`` and ``v_own`` (the ids if not given) tell a query's own row.  ``made`` takes the number of products of each step.
    """
    v_own = v_ids if v_own is None else v_own
    v_len = lengths_of(v)
    order = np.lexsort((v_ids, -v_len))
    v, v_ids, v_own, v_len = v[order], v_ids[order], v_own[order], v_len[order]
    q_len = lengths_of(q)
    least = floor.astype(np.float64)  # the running k-th score; rounding keeps the order of integers
    best = [np.empty((0, 2), np.int64) for _ in q]
    made = [] if made is None else made

    def keep(part: np.ndarray, near: np.ndarray | slice) -> None:
        scores = products(q[part], bucket[near])
        made.append(scores.size)
        _keep(part, scores, ids[near], owns[near], q_own, best, least, k)

    for first in range(0, len(v), BUCKET):
        bucket, ids, owns, lengths = (x[first : first + BUCKET] for x in (v, v_ids, v_own, v_len))
        with np.errstate(over="ignore", invalid="ignore"):
            reach = np.where(q_len > 0, q_len * lengths[0] * (1 + SLACK), 0.0)
        live = np.flatnonzero((reach >= least - 1e-6) | (least <= 0))
        if not len(live):
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(reach[live] > 0, least[live] / reach[live], -1.0)
        direct = (t < COORDINATE_FROM) | ~np.isfinite(q_len[live])
        narrow, wide = live[~direct], live[direct]
        for a in range(0, len(wide), QUERY_ROWS):
            part = wide[a : a + QUERY_ROWS]
            # vectors too short for every query of the part are a tail of the bucket
            need = np.min(np.where(q_len[part] > 0, least[part] / np.maximum(q_len[part], 1e-300), -np.inf))
            keep(part, slice(0, int(np.searchsorted(-lengths, -(need * (1 - SLACK) - 1e-6), side="right"))))
        if len(narrow):
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = np.where(lengths[:, None] > 0, bucket / lengths[:, None], 0.0)
        for i in narrow.tolist():
            near = np.flatnonzero(_feasible(q[i] / q_len[i], unit, min(1.0, least[i] / reach[i])) | ~np.isfinite(lengths))
            if len(near):
                keep(np.array([i]), near)
    return best


def _feasible(q: np.ndarray, unit: np.ndarray, t: float) -> np.ndarray:
    """Unit vectors that can have a cosine of t or more with q, by q's largest coordinates."""
    ok = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        spread = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f])))
        if q[f] >= -t:
            ok &= unit[:, f] >= q[f] * t - spread - 1e-9
        if q[f] <= t:
            ok &= unit[:, f] <= q[f] * t + spread + 1e-9
    return ok


def _keep(part: np.ndarray, scores: np.ndarray, ids: np.ndarray, owns: np.ndarray, q_own: np.ndarray, best: list[np.ndarray], least: np.ndarray, k: int) -> None:
    for row, i in enumerate(part.tolist()):
        s = scores[row]
        near = np.flatnonzero((s >= least[i]) & (owns != q_own[i]))
        if len(near) > 8 * k:  # the k-th largest decides which can matter
            cut = np.partition(s[near], len(near) - k)[len(near) - k]
            near = near[s[near] >= cut]
        if not len(near):
            continue
        rows = np.concatenate([best[i], np.stack([s[near], ids[near]], axis=1)])
        rows = rows[np.lexsort((rows[:, 1], ~rows[:, 0]))][:k]  # ~x falls as x rises, at the ends of the range too
        best[i] = rows
        if len(rows) == k:
            least[i] = max(least[i], float(rows[-1, 0]))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the queries ``vec_id % every == 0`` against all vectors; a query is a row."""
    scratch = Scratch(vectors.sparkSession, "top-k")
    table = scratch.write(quantised(vectors), "vectors")
    pilot = table.orderBy(F.desc("norm"), "row").limit(PILOT).toPandas()  # at most PILOT vectors
    counts = table.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asking")).first()
    per_block = min(BLOCK_ROWS, max(LEAST_BLOCK, counts.n // BLOCKS))
    queries = _with_floor(table.where(F.col("vec_id") % every == 0), pilot, k)
    query_parts = max(1, -(-counts.asking // BLOCK_ROWS))  # a block of queries is a group's other half, so its size is bounded too

    # a length band is a quarter of an octave; its vectors are dealt to as many blocks as it needs
    rows = table.withColumn("band", F.floor(F.log2(F.least(F.greatest(F.col("norm"), F.lit(1.0)), F.lit(1e308))) * 4).cast("int"))
    bands = rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))  # dimensions x some 4,100 bands at most
    bands = bands.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / per_block)).cast("int"))
    asking = F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("asking")
    dealt = rows.join(F.broadcast(bands.select("dim", "band", "parts")), ["dim", "band"])
    dealt = dealt.select("dim", "band", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), asking, "row", "vec_id", "v")
    reach = (F.col("q.norm") * F.col("b.longest") * (1 + SLACK) >= F.col("q.floor") - 1e-6) | (F.col("q.floor") <= 0)
    sent = queries.alias("q").join(F.broadcast(bands).alias("b"), (F.col("q.dim") == F.col("b.dim")) & reach)
    own = F.pmod(F.xxhash64("q.row"), F.lit(query_parts)).cast("int").alias("asking")
    fresh = lambda name: F.col(name).alias(name[2:])  # noqa: E731  both sides of the cogroup come from the same table
    sent = sent.select(fresh("q.dim"), fresh("b.band"), F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)).alias("part"), own, fresh("q.row"), fresh("q.vec_id"), fresh("q.floor"), fresh("q.v"))

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v, v_ids, v_own = matrix(right["v"]), right["vec_id"].to_numpy(), right["row"].to_numpy()
            for a in range(0, len(left), 4 * QUERY_ROWS):
                piece = left.iloc[a : a + 4 * QUERY_ROWS]
                found = retrieve(matrix(piece["v"]), piece["row"].to_numpy(), piece["floor"].to_numpy(), v, v_ids, k, v_own)
                for row, query, best in zip(piece["row"].tolist(), piece["vec_id"].tolist(), found, strict=True):
                    out += [(row, query, int(score), int(other)) for score, other in best]
        return pd.DataFrame(out, columns=["row", "query_id", "score", "vec_id"]).astype("int64")

    by = ["dim", "band", "part", "asking"]
    met = sent.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(meet, "row long, query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_floor(queries: DataFrame, pilot: pd.DataFrame, k: int) -> DataFrame:
    """Queries with the k-th best score they have among the pilot's vectors, a lower bound of the k-th best of all."""
    by_dim = {int(d): (matrix(g["v"]), g["row"].to_numpy()) for d, g in pilot.groupby("dim")} if len(pilot) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for row, dim, packed in zip(*(batch.column(c).to_pylist() for c in ("row", "dim", "v")), strict=True):
                v, rows = by_dim.get(dim, (np.empty((0, dim)), np.empty(0)))
                scores = products(np.frombuffer(packed, "<f8")[None], v)[0][rows != row]
                floors.append(int(np.sort(scores)[-k]) if len(scores) >= k else LONG.min)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], [*batch.schema.names, "floor"])

    return queries.mapInArrow(run, "row long, vec_id long, dim int, norm double, v binary, floor long")
