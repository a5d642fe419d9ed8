"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training happens on the driver over a bounded sample: at most ``MAX_TRAINING_ROWS``
labelled ids, those with the smallest hash, so the choice doesn't depend on
partitioning.  Only the statistics of those rows reach the driver.  The trees are complete
binary trees flattened into arrays; scoring walks all trees of all rows with numpy.

Defined cases: a null text counts as empty; rows without a label, or with a null id or
label, train nothing, nor do ids that are labelled both ways; of rows that share an id the
one with the least statistics trains; if the sample has one class only, every score is that class (an empty
sample gives 0.5).  Extra columns are ignored; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MAX_TRAINING_ROWS = 20_000
HOLD_OUT_FOLDS = 5
BINS = 64

NAMES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "upper", "digits", "space", "newlines", "wide",
    "pipes", "bangs", "symbols", "stops", "commas", "distinct_words", "top_word", "line_bytes", "short_lines", "distinct_lines", "symbol_ended", "upper_words",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\_=+"]] = True
_SYMBOL_END = frozenset(b"#$%&*!@^~|<>{}[]\\_=+")


def statistics(text: str | None) -> list[float]:
    """One number for each of NAMES; all finite, for any text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = raw.split(b"\n")
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths > 12).mean()),
        counts[_UPPER].sum() / n,
        counts[_DIGIT].sum() / n,
        (counts[32] + counts[9]) / n,
        counts[10] / n,
        counts[128:].sum() / n,
        counts[124] / n,
        counts[33] / n,
        counts[_SYMBOL].sum() / n,
        counts[46] / n,
        counts[44] / n,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        len(raw) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
        len(set(lines)) / len(lines),
        sum(w[-1] in _SYMBOL_END for w in seen) / max(1, len(seen)),
        sum(v for w, v in seen.items() if len(w) > 1 and w.isupper()) / m,
    ]


@dataclass
class Forest:
    """Complete binary trees: inner nodes breadth first, then the leaves' values."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same shape; values above it go right
    value: np.ndarray  # (trees, 2**depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(trees)), np.int64)
            for _ in range(self.depth):
                right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            raw += self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40)))


def _edges(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 cuts at about equal shares, half-way between neighbouring values."""
    found = np.unique(values)
    at = np.unique(np.searchsorted(found, np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")))
    at = at[at < len(found) - 1] if len(found) > BINS else np.arange(len(found) - 1)
    return (found[at] + found[at + 1]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Forest:
    """Gradient boosting of the logistic loss over binned features."""
    inner, leaves = 2**depth - 1, 2**depth
    nothing = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
    if not len(y):
        return Forest(0.0, depth, *nothing)
    p = y.mean()
    if p in (0.0, 1.0):
        return Forest(40.0 if p else -40.0, depth, *nothing)
    base = float(np.log(p / (1 - p)))
    features = x.shape[1]
    edges = [_edges(x[:, f]) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(features) * BINS
    all_feature, all_threshold, all_value = [], [], []
    raw = np.full(len(y), base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)  # by default all go left
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            width = 2**level * features * BINS
            at = ((node - first)[:, None] * features * BINS + flat).ravel()
            shape = (2**level, features, BINS)
            g = np.bincount(at, np.repeat(grad, features), width).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, features), width).reshape(shape).cumsum(axis=2)
            n = np.bincount(at, minlength=width).reshape(shape).cumsum(axis=2)
            all_g, all_h, all_n = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(n < least) | (all_n - n < least)] = -1
            best = gain.reshape(2**level, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-9:
                    feature[first + k] = f
                    threshold[first + k] = edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        raw += value[leaf]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_value.append(value)
    return Forest(base, depth, np.array(all_feature), np.array(all_threshold), np.array(all_value))


def held_out(doc_id: Column) -> Column:
    """Rows no label of which may be learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary")) % HOLD_OUT_FOLDS == 0


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Forest:
    """A forest from one row for each of at most ``max_rows`` ids; ids that share texts or labels are reduced first."""
    each = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    )
    sample = each.where("label = other").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = F.broadcast(sample)  # at most max_rows rows of 12 bytes
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(ids.select("doc_id"), "doc_id", "left_semi")
    stats = with_statistics(chosen).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = stats.join(ids, "doc_id").select("doc_id", "label", "x").collect()  # one row an id of the sample
    rows.sort()
    return fit(np.array([r.x for r in rows], float).reshape(len(rows), len(NAMES)), np.array([r.label for r in rows], float))


def score_documents(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with all its columns packed as ``row``, and ``score``."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(forest)  # some kilobytes, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shipped.value.scores(x), pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, out)
