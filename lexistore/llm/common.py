"""Shared pieces: scratch tables in the shared folder, row keys, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside joins; the text key tells such rows apart.
NULL_ID = -(2**63)

#: Odd multiplier of the polynomial hashes over word or line hashes (mod 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session without the setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_root
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="lexistore-")
    return _local_root


_local_root: str | None = None


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes: long texts must not make a batch as large as a task's memory.

    The setting counts when a lazy result runs, so it stays; a smaller value of the caller's own is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name)
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Written intermediate tables of one operator call.

    A written table cuts the lineage, so a lost executor never causes more than the
    current step to run again.  ``drop`` frees a table that nothing lazy reads any more;
    what a returned DataFrame still reads goes at the end of the ``scratch_freed`` block
    that the operator was called in, or when the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_drop)
        for block in _blocks:
            block.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self, *names: str) -> None:
        """Drops tables, and has Spark's cleaner free the shuffle files of plans that are gone."""
        for name in names:
            self.drop(name)
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        self.drop()
        atexit.unregister(self._quietly_drop)

    def _quietly_drop(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # the JVM may have gone already at interpreter exit
            pass


_blocks: list[list[Scratch]] = []


@contextmanager
def scratch_freed() -> Iterator[None]:
    """Frees the tables of all operators called inside; their results must be written or collected before the end."""
    mine: list[Scratch] = []
    _blocks.append(mine)
    try:
        yield
    finally:
        _blocks.remove(mine)
        for scratch in mine:
            scratch.close()


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(row_a, row_b, text): a two-part row key and the text, null read as empty.

    Rows with the same doc_id and the same text share a key; every other pair of rows
    differs in it.  All other columns are left out, so their names can't clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_id_a(), row_id_b(), text.alias("text"))


def by_shuffle(side: DataFrame) -> DataFrame:
    """Marks a side of a join with texts to meet them by a shuffle at every size.

    Such sides grow with the corpus.  A broadcast that only small inputs allow would make
    small runs behave unlike large ones.
    """
    return side.hint("merge")


def row_id_a() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("row_a")


def row_id_b() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull()).alias("row_b")


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered for up to ``limit`` words of ``LONGEST`` bytes at most."""

    LONGEST = 64

    def __init__(self, limit: int = 1 << 19, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        return self._kept(word, xxhash.xxh3_64_intdigest(word, self.seed))

    def _kept(self, word: bytes, value: int) -> int:
        if len(word) <= self.LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of_text(self, raw: bytes) -> np.ndarray:
        return self.of(raw.split())


class Powers:
    """base**i and base**-i (mod 2**64), grown as needed."""

    def __init__(self, base: np.uint64 = BASE) -> None:
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(base), -1, 2**64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, self.base, np.uint64))])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, self.inverse, np.uint64))])
        return self.up, self.down


def range_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of h[first:end] for arrays of coordinates."""
    up, down = powers.upto(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
        return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


class TextHashes:
    """64-bit hashes of a text's words (as ``bytes.split`` cuts them), a piece of the text at a time.

    Polynomials over the words' bytes, each byte first turned into 64 mixed bits; nothing is remembered.
    """

    PIECE = 1 << 20
    SPACE = np.isin(np.arange(256), [32, *range(9, 14)])

    def __init__(self) -> None:
        self.powers = Powers()
        self.values = salted(np.arange(256, dtype=np.uint64), 256)

    def of_text(self, raw: bytes) -> np.ndarray:
        data, parts, first = np.frombuffer(raw, np.uint8), [], 0
        while first < len(data):
            end = min(first + self.PIECE, len(data))
            while end < len(data) and not self.SPACE[data[end - 1]]:  # a piece ends behind a space
                spaces = np.flatnonzero(self.SPACE[data[end : end + self.PIECE]])
                end = end + int(spaces[0]) + 1 if len(spaces) else min(end + self.PIECE, len(data))
            piece = data[first:end]
            change = np.diff(np.concatenate([[True], self.SPACE[piece], [True]]).astype(np.int8))
            starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
            parts.append(range_hashes(self.values[piece], starts, ends, self.powers))
            first = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def window_hashes(values: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive values, mixed; empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        have, piece, step = None, values, 1  # piece: hashes of the last power of two
        size, power = 0, base
        rest = width
        while True:
            if rest & 1:
                if have is None:
                    have, size = piece, step
                else:  # what there is, followed by this power of two
                    m = len(values) - size - step + 1
                    have = have[:m] * power + piece[size : size + m]
                    size += step
            rest >>= 1
            if not rest:
                break
            m = len(values) - 2 * step + 1
            piece = piece[:m] * power + piece[step : step + m]
            step, power = 2 * step, power * power
        return mix(have[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def salted(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))
