"""Versioned store of named collections: Parquet data, epoch commits, recovery, compaction.

Layout under the store's path:

* ``_manifest/NNNNNNNN.json``: one per commit, with a checksum; the newest valid one is the state;
* ``data/<collection>/...``: Parquet directories that manifests refer to;
* ``_lock``: held while a database is open.

A flush writes the pending mutations of all collections and then publishes one manifest, so
an epoch is there as a whole or not at all.  A collection is a base snapshot and the
mutations of later epochs; reading replays them (last write wins) and compaction folds them
into a new base.  Readers keep the version they opened: snapshot isolation.
"""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistore.functions.bounds import Bound, Unbounded
from lexistore.operators import mutations, pops
from lexistore.operators.collection import Collection
from lexistore.sources.files import Files

FORMAT = 1
ENTRY = "key binary, value binary"
MUTATION = "epoch bigint, seq bigint, key binary, gone boolean, value binary"
MAX_CELL = 1 << 30
DEFAULT = 1  # id of the default collection
FEW = 1 << 16  # stored mutations whose keys may be broadcast


class StoreError(Exception):
    """The store can't be opened, or an earlier failure stopped it."""


class Conflict(StoreError):
    """Another writer published this version first; nothing was changed."""


@dataclass
class Config:
    path: str
    zstd_level: int = 3
    rows_per_file: int = 1_000_000
    target_fill_ratio: float = 0.9
    keep_versions: int = 2
    flush_on_close: bool = True
    flush_every: float | None = None  # seconds between flushes in the background

    def open(self, spark: SparkSession) -> Database:
        return Database(spark, self)


@dataclass
class FlushStats:
    epoch: int = 0
    collections: int = 0
    mutations: int = 0
    bytes_written: int = 0
    seconds: float = 0.0

    def sum(self, other: FlushStats) -> FlushStats:
        return FlushStats(*(a + b for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))

    def max(self, other: FlushStats) -> FlushStats:
        return FlushStats(*(max(a, b) for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))


def _hash(state: dict) -> int:
    return zlib.crc32(json.dumps(state, sort_keys=True).encode())


class Database:
    """Set of collections; its own reads and writes go to the default collection."""

    def __init__(self, spark: SparkSession, config: Config | str):
        self.spark = spark
        self.config = Config(config) if isinstance(config, str) else config
        self.files = Files(spark, self.config.path)
        self._error: str | None = None
        self._trees: dict[int, Tree] = {}
        self._mutex, self._stop, self._flusher = threading.RLock(), threading.Event(), None
        if not self.files.create("_lock", uuid.uuid4().hex):
            raise StoreError("the store is open elsewhere (remove _lock if its owner died)")
        try:
            self.version, state = self._newest()
            self.recovered = state is not None
            self.state = state or {"format": FORMAT, "entry": ENTRY, "epoch": 1, "next_id": DEFAULT + 1, "names": {}, "collections": {str(DEFAULT): _new_collection()}, "streams": {}}
            if (self.state["format"], self.state["entry"]) != (FORMAT, ENTRY):
                raise StoreError(f"unsupported format {self.state['format']} {self.state['entry']}")
        except BaseException:
            self.files.delete("_lock")
            raise
        if self.config.flush_every:
            self._flusher = threading.Thread(target=self._flush_often, name="store flusher", daemon=True)
            self._flusher.start()

    def _flush_often(self) -> None:
        while not self._stop.wait(self.config.flush_every):
            try:
                self.flush()
            except Exception as e:  # the next use of the database reports it
                self._error = self._error or f"flush failed: {e}"
                return

    def __enter__(self) -> Database:
        return self

    def __exit__(self, kind, *_) -> None:
        self.close(flush=kind is None and self.config.flush_on_close)

    def close(self, flush: bool = True) -> None:
        self._stop.set()
        if self._flusher:
            self._flusher.join()
        try:
            if flush and not self._error:
                self.flush()
        finally:
            self.files.delete("_lock")

    # manifests

    def _valid(self) -> Iterator[tuple[str, dict]]:
        """Names and states of the whole manifests, newest first; read as they are asked for."""
        for name in reversed([n for n in self.files.names("_manifest") if n.endswith(".json")]):
            try:
                held = json.loads(self.files.read(f"_manifest/{name}"))
            except ValueError:
                continue  # torn: never became a commit
            if "state" in held and _hash(held["state"]) == held.get("crc"):
                yield name, held["state"]

    def _newest(self) -> tuple[int, dict | None]:
        names = [n for n in self.files.names("_manifest") if n.endswith(".json")]
        return int(names[-1][:8]) if names else 0, next((state for _, state in self._valid()), None)

    def _publish(self, state: dict) -> None:
        version = self.version + 1
        if not self.files.create(f"_manifest/{version:08d}.json", json.dumps({"crc": _hash(state), "state": state})):
            raise Conflict(f"version {version} exists")
        self.version, self.state = version, state

    def check_error(self) -> None:
        if self._error:
            raise StoreError(self._error)

    # catalog

    def tree(self, name: bytes | None = None) -> Tree:
        """The named collection, made if need be; None is the default one."""
        self.check_error()
        with self._mutex:
            if name is None:
                at = DEFAULT
            elif name.hex() in self.state["names"]:
                at = self.state["names"][name.hex()]
            else:
                state = json.loads(json.dumps(self.state))
                at = state["next_id"]
                state["next_id"] += 1
                state["names"][name.hex()] = at
                state["collections"][str(at)] = _new_collection()
                self._publish(state)
            return self._trees.setdefault(at, Tree(self, at))

    def contains_tree(self, name: bytes) -> bool:
        return name.hex() in self.state["names"]

    def drop_tree(self, name: bytes) -> bool:
        """Removes name and data in one commit; false if there is no such collection."""
        self.check_error()
        with self._mutex:
            if not self.contains_tree(name):
                return False
            state = json.loads(json.dumps(self.state))
            at = state["names"].pop(name.hex())
            del state["collections"][str(at)]
            self._publish(state)
            self._trees.pop(at, None)
            return True

    def tree_names(self) -> list[bytes]:
        return sorted(map(bytes.fromhex, self.state["names"]))

    # commits

    def flush(self, stream: str | None = None, batch_id: int | None = None) -> FlushStats:
        """Makes all pending writes durable as one epoch."""
        self.check_error()
        with self._mutex:
            began = time.time()
            pending = {i: t for i, t in self._trees.items() if t.pending}
            if not pending and stream is None:
                return FlushStats(epoch=self.state["epoch"])
            with self._sticky("flush"):
                state = json.loads(json.dumps(self.state))
                state["epoch"] += 1
                stats = FlushStats(epoch=state["epoch"], collections=len(pending))
                for i, t in pending.items():
                    held = state["collections"][str(i)]
                    at = f"data/{i}/epoch-{state['epoch']}-{uuid.uuid4().hex}"
                    rows = self._write(t._pending_log(state["epoch"]), at, sort=["key", "seq"])
                    if rows:
                        held["deltas"].append({"path": at, "rows": rows, "epoch": state["epoch"]})
                        stats.mutations += rows
                        stats.bytes_written += self.files.bytes(at)
                if stream is not None:
                    state["streams"][stream] = batch_id
                stats.seconds = time.time() - began
                so_far = _totals(state)
                state["totals"] = {"flushes": so_far["flushes"] + 1, "sum": vars(so_far["sum"].sum(stats)), "max": vars(so_far["max"].max(stats))}
                self._publish(state)
            for t in pending.values():
                t.pending.clear()
            return stats

    @contextmanager
    def _sticky(self, what: str) -> Iterator[None]:
        """A failure other than a conflict stops the database: every later use reports it."""
        try:
            yield
        except Conflict:
            raise
        except Exception as e:
            self._error = f"{what} failed: {e}"
            raise

    def _write(self, df: DataFrame, at: str, sort: list[str]) -> int:
        """Key-sorted, range-partitioned files, whose statistics let range scans skip them; the number of rows."""
        too_long = lambda c: F.when(F.octet_length(c) > MAX_CELL, F.raise_error(F.lit(f"a {c} is larger than {MAX_CELL} bytes"))).otherwise(F.col(c))
        checked = df.withColumns({"key": too_long("key"), "value": too_long("value")})
        rows = checked.repartitionByRange("key").sortWithinPartitions(*sort)
        rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", self.config.zstd_level).option("maxRecordsPerFile", self.config.rows_per_file).parquet(f"{self.config.path}/{at}")
        return self.spark.read.schema(df.schema).parquet(f"{self.config.path}/{at}").count()  # from the files' footers

    # maintenance

    def defrag_candidates(self) -> list[tuple[int, int, int]]:
        """(collection, live rows, all rows) of the collections with mutations whose live rows fall under the target ratio."""
        out = []
        for i, held in self.state["collections"].items():
            if held["deltas"]:
                total = held["rows"] + sum(d["rows"] for d in held["deltas"])
                live = self._snapshot(held).count()
                if live < self.config.target_fill_ratio * total:
                    out.append((int(i), live, total))
        return out

    def compact(self, force: bool = False) -> int:
        """Folds mutations into new bases, of the candidates or (by force) of all; the number of collections done."""
        self.check_error()
        with self._mutex, self._sticky("compaction"):
            state, done = json.loads(json.dumps(self.state)), 0
            chosen = None if force else {i for i, _, _ in self.defrag_candidates()}
            for i, held in state["collections"].items():
                if held["deltas"] and (chosen is None or int(i) in chosen):
                    at = f"data/{i}/base-{uuid.uuid4().hex}"
                    rows = self._write(self._snapshot(held), at, sort=["key"])
                    held |= {"base": at if rows else None, "rows": rows, "deltas": []}
                    done += 1
            if done:
                self._publish(state)
            return done

    def vacuum(self) -> int:
        """Deletes data that none of the newest ``keep_versions`` manifests refer to; the bytes freed."""
        newest = list(itertools.islice(self._valid(), self.config.keep_versions))
        kept = {p for _, state in newest for held in state["collections"].values() for p in (held["base"], *(d["path"] for d in held["deltas"]))}
        before = self.files.bytes()
        for i in self.files.names("data"):
            for part in self.files.names(f"data/{i}"):
                if f"data/{i}/{part}" not in kept:
                    self.files.delete(f"data/{i}/{part}")
        for name in self.files.names("_manifest"):
            if newest and name < newest[-1][0]:
                self.files.delete(f"_manifest/{name}")
        return before - self.files.bytes()

    def size_on_disk(self) -> int:
        return self.files.bytes()

    def was_recovered(self) -> bool:
        return self.recovered

    def stats(self) -> dict:
        """Versions, sizes, and the sum and maximum of all flushes since the store was made."""
        held = {i: {"rows": h["rows"], "deltas": len(h["deltas"]), "delta_rows": sum(d["rows"] for d in h["deltas"])} for i, h in self.state["collections"].items()}
        return {"version": self.version, "epoch": self.state["epoch"], **_totals(self.state), "disk_bytes": self.size_on_disk(), "collections": held}

    def files_of(self, name: bytes | None = None) -> DataFrame:
        """file, lo, hi and rows of the base files of a collection: contiguous, apart from each other."""
        held = self.state["collections"][str(self.tree(name).id)]
        base = self._read(held["base"], ENTRY)
        return base.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")) if held["base"] else self.spark.createDataFrame([], "file string, lo binary, hi binary, n bigint")

    def validate(self) -> None:
        """Raises if a collection has a key twice or base files whose key ranges overlap."""
        for name in [None, *self.tree_names()]:
            t = self.tree(name)
            if not t.collection().duplicates().isEmpty():
                raise StoreError(f"a key is there twice in collection {t.id}")
            files = sorted(self.files_of(name).collect(), key=lambda r: (r.lo, r.hi))
            if any(a.hi >= b.lo for a, b in zip(files, files[1:], strict=False)):
                raise StoreError(f"files overlap in collection {t.id}")

    # snapshots

    def _read(self, path: str | None, schema: str) -> DataFrame:
        if path is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.config.path}/{path}")

    def _snapshot(self, held: dict, upto: int | None = None) -> DataFrame:
        deltas = [d for d in held["deltas"] if upto is None or d["epoch"] <= upto]
        base = self._read(held["base"], ENTRY)
        if not deltas:
            return base
        log = self.spark.read.schema(MUTATION).parquet(*[f"{self.config.path}/{d['path']}" for d in deltas])
        return _over(base, log, unique=len(deltas) == 1, few=sum(d["rows"] for d in deltas) <= FEW)

    # export and import

    def export(self, path: str, default: bool = True) -> None:
        """All collections as one Parquet directory: type, name (null: the default one), key, value."""
        parts = [(n, self.tree(n)) for n in ([None] if default else []) + self.tree_names()]
        rows = None
        for name, t in parts:
            part = t.collection().df.select(F.lit("tree").alias("type"), F.lit(name).cast("binary").alias("name"), "key", "value")
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            rows = self.spark.createDataFrame([], "type string, name binary, key binary, value binary")
        rows.write.parquet(path)

    def _exported(self, path: str) -> tuple[DataFrame, list[bytes | None]]:
        rows = self.spark.read.schema("type string, name binary, key binary, value binary").parquet(path)
        if not rows.where("type <> 'tree' or type is null").isEmpty():
            raise StoreError("unknown collection type in the export")
        names = [r[0] for r in rows.select("name").distinct().collect()]  # as many as there are collections
        return rows, [None if n is None else bytes(n) for n in names]

    def conflicts(self, path: str) -> DataFrame:
        """name and key of the entries of an export that an import would overwrite; makes no collection."""
        rows, names = self._exported(path)
        found = self.spark.createDataFrame([], "name binary, key binary")
        for name in names:
            if name is None or self.contains_tree(name):
                mine = rows.where(F.col("name").eqNullSafe(F.lit(name)))
                found = found.unionByName(mine.join(mutations.by_shuffle(self.tree(name).collection().keys()), "key", "left_semi").select("name", "key"))
        return found

    def import_(self, path: str) -> None:
        """Adds an export; raises, and changes nothing, if a key is there already or a type is unknown."""
        if not self.conflicts(path).isEmpty():
            raise StoreError("the import would overwrite keys")
        rows, names = self._exported(path)
        for name in names:
            self.tree(name).insert(rows.where(F.col("name").eqNullSafe(F.lit(name))).select("key", "value"))
        self.flush()


def _totals(state: dict) -> dict:
    held = state.get("totals", {"flushes": 0, "sum": {}, "max": {}})
    return {"flushes": held["flushes"], "sum": FlushStats(**held["sum"]), "max": FlushStats(**held["max"])}


def _new_collection() -> dict:
    return {"base": None, "rows": 0, "deltas": []}


def _over(base: DataFrame, log: DataFrame, unique: bool = False, few: bool = False) -> DataFrame:
    """A base with a log of mutations put over it.  ``unique``: no key is in the log twice, as in the one of a single flush."""
    last = log.select("key", "gone", "value") if unique else log.groupBy("key").agg(F.max_by(F.struct("gone", "value"), F.struct("epoch", "seq")).alias("m")).select("key", "m.*")
    return mutations.overlay(base, last, "key", "gone", shuffled=not few)


@dataclass
class Tree:
    """One collection.  Writes are pending until the database flushes; own reads see them."""

    db: Database
    id: int
    pending: list[DataFrame] = field(default_factory=list)

    def _pending_log(self, epoch: int) -> DataFrame:
        rows = None
        for n, df in enumerate(self.pending):
            part = df.withColumn("seq", F.lit(n).cast("bigint"))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.db.spark.createDataFrame([], MUTATION)
        # of rows with one key in the same write the greatest value counts
        last = rows.groupBy("key").agg(F.max_by(F.struct("gone", "value", "seq"), F.struct("seq", "gone", "value")).alias("m"))
        return last.select(F.lit(epoch).cast("bigint").alias("epoch"), F.col("m.seq").alias("seq"), "key", F.col("m.gone").alias("gone"), F.col("m.value").alias("value"))

    def collection(self, epoch: int | None = None) -> Collection:
        """The collection as it is, or as of an epoch not yet compacted away."""
        self.db.check_error()
        df = self.db._snapshot(self.db.state["collections"][str(self.id)], epoch)
        if epoch is None and self.pending:
            df = _over(df, self._pending_log(self.db.state["epoch"] + 1), unique=True)
        return Collection(df)

    def _add(self, df: DataFrame) -> None:
        self.db.check_error()
        with self.db._mutex:
            self.pending.append(df)

    def insert(self, entries: DataFrame) -> DataFrame:
        """Upserts rows (key, value); gives each key with its previous value.

        Equal values write nothing.  Of rows that share a key the one with the greatest value counts.
        """
        before = self.collection().df
        puts = entries.groupBy("key").agg(F.max("value").alias("value")).withColumn("gone", F.lit(False))
        self._add(mutations.effective(before, puts, "key", "value", "gone").select("key", "gone", "value"))
        return entries.select("key").join(mutations.by_shuffle(before.withColumnRenamed("value", "previous")), "key", "left")

    def remove(self, keys: DataFrame) -> DataFrame:
        """Deletes keys; gives each with its previous value.  Missing keys write nothing."""
        before = self.collection().df
        self._add(keys.select("key").join(mutations.by_shuffle(before.select("key")), "key", "left_semi").select("key", F.lit(True).alias("gone"), F.lit(None).cast("binary").alias("value")))
        return keys.select("key").join(mutations.by_shuffle(before.withColumnRenamed("value", "previous")), "key", "left")

    def apply_batch(self, batch: DataFrame) -> None:
        """Atomic batch: rows (seq, key, gone, value); the last operation on a key counts."""
        last = mutations.dedupe_batch(batch, "key", "seq", ["gone", "value"])
        self._add(mutations.effective(self.collection().df, last, "key", "value", "gone").select("key", "gone", "value"))

    def compare_and_swap(self, ops: DataFrame) -> DataFrame:
        """Ordered operations (seq, key, expected, new); their outcomes, applied to the collection."""
        held = self.collection().df.join(mutations.by_shuffle(ops.select("key").distinct()), "key", "left_semi")
        start = held.select("key", F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("binary").alias("expected"), F.col("value").alias("new"))
        log = start.unionByName(ops.select("key", F.col("seq").cast("bigint").alias("seq"), "expected", "new"))
        done = mutations.compare_and_swap(log, "key", "seq", "expected", "new").where("seq >= 0")
        last = mutations.latest(done, "key", "seq", ["current"])
        self._add(last.select("key", F.col("current").isNull().alias("gone"), F.col("current").alias("value")))
        return done

    def update_and_fetch(self, keys: DataFrame, f) -> DataFrame:
        """Applies a Column function (previous value or null -> new value or null) once to each key; gives the new values."""
        rows = keys.select("key").distinct().join(mutations.by_shuffle(self.collection().df), "key", "left").select("key", f(F.col("value")).alias("value"))
        self._add(rows.select("key", F.col("value").isNull().alias("gone"), "value"))
        return rows

    def fetch_and_update(self, keys: DataFrame, f) -> DataFrame:
        """The same, giving the previous values."""
        before = keys.select("key").distinct().join(mutations.by_shuffle(self.collection().df), "key", "left")
        self.update_and_fetch(keys, f)
        return before

    def pop_first(self, n: int = 1, start: Bound = Unbounded, end: Bound = Unbounded) -> DataFrame:
        return self._pop(pops.pop_first, n, start, end)

    def pop_last(self, n: int = 1, start: Bound = Unbounded, end: Bound = Unbounded) -> DataFrame:
        return self._pop(pops.pop_last, n, start, end)

    def _pop(self, how, n: int, start: Bound, end: Bound) -> DataFrame:
        popped, _ = how(self.collection(), n, start, end)
        at = f"data/{self.id}/popped-{uuid.uuid4().hex}"
        popped.write.parquet(f"{self.db.config.path}/{at}")  # fixed before the delete is added; vacuum clears it
        rows = self.db._read(at, ENTRY)
        self._add(rows.select("key", F.lit(True).alias("gone"), F.lit(None).cast("binary").alias("value")))
        return rows

    def clear(self) -> None:
        """Empties the collection in one commit, pending writes included."""
        with self.db._mutex:
            state = json.loads(json.dumps(self.db.state))
            state["collections"][str(self.id)] = _new_collection()
            self.pending.clear()
            self.db._publish(state)
