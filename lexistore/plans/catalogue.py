"""The query catalogue: every operator over the driver's tables, with its DuckDB oracle.

Collections: ``orders`` by o_orderkey, ``customer`` by c_custkey or c_name, ``pages`` by url,
``events`` by event_id; ``events`` is also a mutation log with key user_id and order event_id.
"""

from __future__ import annotations

import json
import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexistore.functions.bounds import Excluded, Included, Unbounded, prefix_range
from lexistore.functions.codec import long_from_key, long_key, text_key
from lexistore.operators import mutations, pops
from lexistore.operators.checksum import checksum
from lexistore.operators.collection import Collection
from lexistore.sources.files import Files
from lexistore.sources.store import Config, Conflict, Database, StoreError
from lexistore.streaming.ingest import counters, ingest, registers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


def customers(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays the events log into a snapshot and scans a key range of it in order."""
    return Collection(_tombstoned(spark, sf_dir), "user_id").range(Included(10), Excluded(120), reverse=False)


def _tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return mutations.replay(log, "user_id", "event_id", ["value"], F.col("event_type") == "error")


_SNAPSHOT = """SELECT user_id, value FROM (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) AS s WHERE t <> 'error'"""


@query(f"SELECT * FROM ({_SNAPSHOT}) AS s WHERE user_id >= 10 AND user_id < 120")
def q00_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


# reads


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def q01_get(spark, sf_dir):
    return orders(spark, sf_dir).get(42)


@query("""SELECT p.event_id, p.k, o.o_totalprice, o.o_orderkey IS NOT NULL AS found
    FROM (SELECT event_id, event_id * 3 AS k FROM events) AS p LEFT JOIN orders AS o ON o.o_orderkey = p.k""")
def q02_get_many(spark, sf_dir):
    probes = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 3).alias("k"))
    return orders(spark, sf_dir).get_many(probes, "k")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q03_contains_key(spark, sf_dir):
    held = Collection(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey")
    return held.contained(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT c.k, c_name FROM (SELECT c_custkey * 3 AS k, c_name FROM customer) AS c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.k)")
def q04_not_contained(spark, sf_dir):
    held = Collection(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey")
    return held.not_contained(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("k"), "c_name"), "k")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 1")
def q05_get_lt(spark, sf_dir):
    return orders(spark, sf_dir).get_lt(500)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1")
def q06_get_gt(spark, sf_dir):
    return orders(spark, sf_dir).get_gt(500)


_SPARSE = "(SELECT max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey)"


def _last_orders(spark: SparkSession, sf_dir: str) -> Collection:
    """Each customer's last order: a sparse set of keys."""
    rows = mutations.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_totalprice"])
    return Collection(rows.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query(f"SELECT p.event_id, p.k, o.o_orderkey, o.o_totalprice FROM (SELECT event_id, event_id * 2 AS k FROM events) AS p ASOF LEFT JOIN {_SPARSE} AS o ON p.k > o.o_orderkey")
def q07_get_lt_many(spark, sf_dir):
    return _last_orders(spark, sf_dir).get_lt_many(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2).alias("k")), "k")


@query(f"SELECT p.event_id, p.k, o.o_orderkey, o.o_totalprice FROM (SELECT event_id, event_id * 2 AS k FROM events) AS p ASOF LEFT JOIN {_SPARSE} AS o ON p.k < o.o_orderkey")
def q08_get_gt_many(spark, sf_dir):
    return _last_orders(spark, sf_dir).get_gt_many(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2).alias("k")), "k")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1")
def q09_first(spark, sf_dir):
    return orders(spark, sf_dir).first()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def q10_last(spark, sf_dir):
    return orders(spark, sf_dir).last()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def q11_range(spark, sf_dir):
    return orders(spark, sf_dir).range(Included(100), Excluded(200))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def q12_range_inclusive(spark, sf_dir):
    return orders(spark, sf_dir).range(Included(100), Included(200))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey < 200")
def q13_range_exclusive(spark, sf_dir):
    return orders(spark, sf_dir).range(Excluded(100), Excluded(200))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 50")
def q14a_range_to(spark, sf_dir):
    return orders(spark, sf_dir).range(Unbounded, Included(50))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1400")
def q14b_range_from(spark, sf_dir):
    return orders(spark, sf_dir).range(Included(1400), Unbounded)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 200 AND o_orderkey < 100")
def q14c_range_inverted(spark, sf_dir):
    return orders(spark, sf_dir).range(Included(200), Excluded(100))


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS position
    FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 300 ORDER BY o_orderkey DESC LIMIT 40) AS s""")
def q15_reverse_take(spark, sf_dir):
    return orders(spark, sf_dir).take(40, Included(300), reverse=True, position="position")


@query("SELECT c_name, c_acctbal FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def q16_scan_prefix(spark, sf_dir):
    return Collection(table(spark, sf_dir, "customer").select("c_name", "c_acctbal"), "c_name").scan_prefix("Customer#0000001")


@query("SELECT url, page_id FROM pages WHERE starts_with(url, 'http://th')")
def q17_scan_prefix_url(spark, sf_dir):
    return Collection(table(spark, sf_dir, "pages").select("url", "page_id"), "url").scan_prefix("http://th")


# Binary keys (hex) around FF tails, and the prefixes scanned.
_EDGE_KEYS = ["", "00", "01", "01FE", "01FF", "01FF00", "01FFFF", "02", "FE", "FF", "FF00", "FFFF", "FFFF01"]
_EDGE_PREFIXES = ["", "01", "01FF", "FF", "FFFF", "03"]


@query("SELECT p AS prefix, k FROM (VALUES " + ",".join(f"('{p}')" for p in _EDGE_PREFIXES) + ") AS x(p), (VALUES " + ",".join(f"('{k}')" for k in _EDGE_KEYS) + ") AS y(k) WHERE starts_with(k, p)")
def q18_scan_prefix_bytes(spark, sf_dir):
    keys = Collection(spark.createDataFrame([(bytes.fromhex(k),) for k in _EDGE_KEYS], "key binary"))
    out = None
    for p in _EDGE_PREFIXES:
        part = keys.range(*prefix_range(bytes.fromhex(p))).select(F.lit(p).alias("prefix"), F.hex("key").alias("k"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def q19_keys(spark, sf_dir):
    c = orders(spark, sf_dir)
    return Collection(c.range(Included(100), Excluded(200)), c.key).keys()


@query("SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def q20_values(spark, sf_dir):
    return orders(spark, sf_dir).enumerate("position").drop("o_orderkey")


@query("SELECT 'orders' AS name, count(*) AS len FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def q21_len(spark, sf_dir):
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id"}
    parts = [Collection(table(spark, sf_dir, n), k).len().select(F.lit(n).alias("name"), "len") for n, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT 'hit' AS name, NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200) AS is_empty
    UNION ALL SELECT 'miss', NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey < 0)""")
def q22_is_empty(spark, sf_dir):
    c = orders(spark, sf_dir)
    ranges = {"hit": c.range(Included(100), Excluded(200)), "miss": c.range(Unbounded, Excluded(0))}
    return spark.createDataFrame([(n, Collection(df, c.key).is_empty()) for n, df in ranges.items()], "name string, is_empty boolean")


# writes


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def q23_insert(spark, sf_dir):
    return mutations.latest(table(spark, sf_dir, "events"), "user_id", "event_id", ["value"])


@query("SELECT user_id, event_id, lag(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events")
def q24_insert_previous(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return mutations.previous(log, "user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value"))).select("user_id", "event_id", "previous")


@query(_SNAPSHOT)
def q25_remove(spark, sf_dir):
    return _tombstoned(spark, sf_dir)


def _cas_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cas_of(table(spark, sf_dir, "events"))


def _cas_of(events: DataFrame) -> DataFrame:
    floored = lambda c: F.floor(c).cast("long")
    return events.select(
        "user_id", "event_id",
        F.when(~F.col("event_type").isin("signup", "click"), floored(F.col("value")) % 3).alias("expected"),
        F.when(F.col("event_type") != "error", floored(F.col("value") / 3) % 3).alias("new"),
    )


_CAS = """WITH RECURSIVE ops AS (
        SELECT user_id, event_id, CASE WHEN event_type NOT IN ('signup', 'click') THEN CAST(floor(value) AS BIGINT) % 3 END AS e,
            CASE WHEN event_type <> 'error' THEN CAST(floor(value / 3) AS BIGINT) % 3 END AS n,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
    ), r AS (
        SELECT user_id, event_id, i, e IS NULL AS ok, CAST(NULL AS BIGINT) AS previous, n AS proposed, CASE WHEN e IS NULL THEN n END AS cur FROM ops WHERE i = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.i, r.cur IS NOT DISTINCT FROM o.e, r.cur, o.n, CASE WHEN r.cur IS NOT DISTINCT FROM o.e THEN o.n ELSE r.cur END
        FROM r JOIN ops AS o ON o.user_id = r.user_id AND o.i = r.i + 1
    )"""


@query(_CAS + " SELECT user_id, cur AS value FROM (SELECT *, max(i) OVER (PARTITION BY user_id) AS final FROM r) AS t WHERE i = final AND cur IS NOT NULL")
def q26_cas_state(spark, sf_dir):
    return mutations.cas_state(mutations.compare_and_swap(_cas_log(spark, sf_dir), "user_id", "event_id", "expected", "new"), "user_id")


@query(_CAS + " SELECT user_id, event_id, ok, previous, proposed, cur AS current FROM r")
def q27_cas_outcomes(spark, sf_dir):
    return mutations.compare_and_swap(_cas_log(spark, sf_dir), "user_id", "event_id", "expected", "new").withColumnRenamed("seq", "event_id")


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.running_count(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM events")
def q28_update_and_fetch(spark, sf_dir):
    return _counter(spark, sf_dir).select("user_id", "event_id", "new")


@query("SELECT user_id, event_id, nullif(count(*) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 0) AS old FROM events")
def q29_fetch_and_update(spark, sf_dir):
    return _counter(spark, sf_dir).select("user_id", "event_id", "old")


_TOTALS = "SELECT user_id, event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 10 AS step FROM events) AS s"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value").cast("long") % 10).alias("step"))


@query(_TOTALS)
def q29b_read_modify_write(spark, sf_dir):
    add = lambda s, op: F.coalesce(s, F.lit(0).cast("long")) + op["step"]
    return mutations.fold(_steps(spark, sf_dir), "user_id", "event_id", add, "bigint", lambda s, op: F.struct(op["event_id"].alias("event_id"), add(s, op).alias("total")))


@query(_TOTALS)
def q29c_read_modify_write_by_rows(spark, sf_dir):
    def add(total, row):
        total = (total or 0) + row["step"]
        return total, (row["event_id"], total)

    return mutations.fold_rows(_steps(spark, sf_dir), "user_id", "event_id", add, "event_id long, total long")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are rewritten and copied to a new key, pending ones are deleted, open ones stay."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    finished = rows.where("o_orderstatus = 'F'")
    changed = finished.select("o_orderkey", (F.col("o_orderkey") * 1.0).alias("o_totalprice"), F.lit(False).alias("gone"))
    deleted = rows.where("o_orderstatus = 'P'").select("o_orderkey", F.lit(None).cast("double").alias("o_totalprice"), F.lit(True).alias("gone"))
    added = finished.select((F.lit(-1) - F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", F.lit(False).alias("gone"))
    return changed.unionByName(deleted).unionByName(added)


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus NOT IN ('F', 'P')
    UNION ALL SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT -1 - o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def q30_apply_batch(spark, sf_dir):
    return mutations.overlay(orders(spark, sf_dir).df, _batch(spark, sf_dir), "o_orderkey", "gone")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def q31_batch_last_wins(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    return mutations.dedupe_batch(batch, "user_id", "event_id", ["event_id", "event_type", "value"])


@query("""SELECT p.o_orderkey, CASE WHEN p.o_orderstatus = 'F' THEN CAST(p.o_orderkey AS DOUBLE) END AS o_totalprice,
    CASE p.o_orderstatus WHEN 'F' THEN 'put' WHEN 'P' THEN 'delete' ELSE 'absent' END AS status FROM orders AS p""")
def q32_batch_get(spark, sf_dir):
    return mutations.batch_get(orders(spark, sf_dir).keys(), _batch(spark, sf_dir), "o_orderkey", "gone")


def _popped(popped: DataFrame, rest: Collection) -> DataFrame:
    left = rest.len().select(F.lit("left").alias("what"), F.lit(None).cast("bigint").alias("o_orderkey"), F.col("len").alias("n"))
    return popped.select(F.lit("popped").alias("what"), "o_orderkey", F.lit(1).cast("bigint").alias("n")).unionByName(left)


@query("""SELECT 'popped' AS what, o_orderkey, CAST(1 AS BIGINT) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10) AS s
    UNION ALL SELECT 'left', NULL, count(*) - 10 FROM orders""")
def q33_pop_first(spark, sf_dir):
    return _popped(*pops.pop_first(orders(spark, sf_dir), 10))


@query("""SELECT 'popped' AS what, o_orderkey, CAST(1 AS BIGINT) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10) AS s
    UNION ALL SELECT 'left', NULL, count(*) - 10 FROM orders""")
def q34_pop_last(spark, sf_dir):
    return _popped(*pops.pop_last(orders(spark, sf_dir), 10))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 200 ORDER BY o_orderkey LIMIT 5)")
def q35a_pop_first_in_range(spark, sf_dir):
    return pops.pop_first(orders(spark, sf_dir), 5, Excluded(100), Included(200))[1].df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 ORDER BY o_orderkey DESC LIMIT 5)")
def q35b_pop_last_in_range(spark, sf_dir):
    return pops.pop_last(orders(spark, sf_dir), 5, Included(100), Excluded(200))[1].df


@query("SELECT CAST(0 AS BIGINT) AS len")
def q36_clear(spark, sf_dir):
    return pops.clear(orders(spark, sf_dir)).len()


# database: every query opens a store in the shared folder, writes to it and reads it back

_SOURCES = {"orders": ("o_orderkey", "o_orderstatus"), "customer": ("c_custkey", "c_name"), "events": ("event_id", "event_type")}


def _shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='lexistore-')}"


def _place(spark: SparkSession, name: str) -> str:
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _database(spark: SparkSession, **config) -> Database:
    return Config(_place(spark, "db"), **config).open(spark)


def _entries(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key, value = _SOURCES[name]
    return table(spark, sf_dir, name).select(long_key(F.col(key)).alias("key"), text_key(F.col(value)).alias("value"))


def _filled(spark: SparkSession, sf_dir: str, db: Database, names: list[str]) -> None:
    for name in names:
        db.tree(name.encode()).insert(_entries(spark, sf_dir, name))
    db.flush()


def _sql_key(column: str) -> str:
    """Hex of the order-preserving key of a non-negative integer below 2**31."""
    return f"'80000000' || lpad(upper(hex({column})), 8, '0')"


@query(" UNION ALL ".join(f"SELECT 'tree' AS type, '{n}' AS name, {_sql_key(k)} AS key, upper(hex(encode({v}))) AS value FROM {n}" for n, (k, v) in _SOURCES.items()))
def q37_export(spark, sf_dir):
    at = _place(spark, "export")
    with _database(spark) as db:
        _filled(spark, sf_dir, db, list(_SOURCES))
        db.export(at, default=False)
    return spark.read.parquet(at).select("type", F.decode("name", "UTF-8").alias("name"), F.hex("key").alias("key"), F.hex("value").alias("value"))


@query("SELECT CAST(c_custkey AS BIGINT) AS key, true AS refused FROM customer WHERE c_custkey IN (SELECT o_orderkey FROM orders)")
def q38_import_conflict(spark, sf_dir):
    """An export of customers comes to a store whose collection holds orders: the keys it would overwrite, and that it is refused."""
    at = _place(spark, "export")
    with _database(spark) as db:
        db.tree(b"t").insert(_entries(spark, sf_dir, "customer"))
        db.export(at)
    with _database(spark) as db:
        db.tree(b"t").insert(_entries(spark, sf_dir, "orders"))
        db.flush()
        try:
            db.import_(at)
            refused = False
        except StoreError:
            refused = not db.tree(b"t").pending
        return db.conflicts(at).select(long_from_key(F.col("key")).alias("key"), F.lit(refused).alias("refused"))


@query("SELECT 'tree' AS type, o_orderkey AS key, o_orderstatus AS value FROM orders UNION ALL SELECT 'default', c_custkey, c_name FROM customer")
def q38b_import(spark, sf_dir):
    """A collection and the default one, exported from one store and imported by another."""
    at = _place(spark, "export")
    with _database(spark) as db:
        db.tree(b"t").insert(_entries(spark, sf_dir, "orders"))
        db.tree().insert(_entries(spark, sf_dir, "customer"))
        db.export(at)
    with _database(spark) as db:
        db.import_(at)
        parts = [db.tree(n).collection().df.select(F.lit(kind).alias("type"), long_from_key(F.col("key")).alias("key"), F.decode("value", "UTF-8").alias("value")) for n, kind in ((b"t", "tree"), (None, "default"))]
        return parts[0].unionByName(parts[1])


def _catalog(spark: SparkSession, drop: bool) -> DataFrame:
    with _database(spark) as db:
        for name in (b"tree 1", b"tree 2", b"tree 3", b"tree 1"):
            db.tree(name)
        dropped = [db.drop_tree(b"tree 2"), db.drop_tree(b"tree 2")] if drop else []
        rows = [(n.decode(), db.contains_tree(n)) for n in (b"tree 1", b"tree 2", b"tree 3", b"tree 4")]
        rows += [(f"drop {i}", done) for i, done in enumerate(dropped)]
    return spark.createDataFrame(rows, "name string, present boolean")


@query("SELECT * FROM (VALUES ('tree 1', true), ('tree 2', true), ('tree 3', true), ('tree 4', false)) AS t(name, present)")
def q39_open_tree(spark, sf_dir):
    return _catalog(spark, drop=False)


@query("SELECT * FROM (VALUES ('tree 1', true), ('tree 2', false), ('tree 3', true), ('tree 4', false), ('drop 0', true), ('drop 1', false)) AS t(name, present)")
def q40_drop_tree(spark, sf_dir):
    return _catalog(spark, drop=True)


@query(f"SELECT c_custkey // 1024 AS leaf, md5(string_agg({_sql_key('c_custkey')} || upper(hex(encode(c_name))), '' ORDER BY c_custkey)) AS digest FROM customer GROUP BY 1")
def q41a_ordered_digest(spark, sf_dir):
    """An order-sensitive digest of each leaf of 1024 keys."""
    entry = F.struct("c_custkey", F.concat(F.hex(long_key(F.col("c_custkey"))), F.hex(text_key(F.col("c_name")))).alias("x"))
    leaves = customers(spark, sf_dir).df.groupBy(F.floor(F.col("c_custkey") / 1024).cast("long").alias("leaf")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return leaves.select("leaf", F.md5(F.array_join(F.transform("entries", lambda e: e["x"]), "")).alias("digest"))


# CRC-32 in SQL.  ``bytes``: a table made by rule.  Each entry is summed by itself; appending n bytes is a linear
# map of the 32 bits, of which ``ops`` holds the powers of two, so an entry's part of the whole is its sum, moved
# on by all the bytes that follow it.
_CRC_APPLY = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(32), lambda b: CASE WHEN (({v}) >> b) & 1 = 1 THEN {m}[b + 1] ELSE CAST(0 AS BIGINT) END)), lambda x, y: xor(x, y))"
_CRC_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_CRC = f"""WITH RECURSIVE step(n, i, x) AS (
        SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT n, i + 1, {_CRC_BIT} FROM step WHERE i < 8
    ), bytes AS (SELECT list(x ORDER BY n) AS t FROM step WHERE i = 8),
    basis(b, i, x) AS (SELECT b, 0, CAST(1 AS BIGINT) << b FROM range(32) AS r(b) UNION ALL SELECT b, i + 1, {_CRC_BIT} FROM basis WHERE i < 8),
    ops(k, m) AS (
        SELECT 0, (SELECT list(x ORDER BY b) FROM basis WHERE i = 8)
        UNION ALL SELECT k + 1, list_transform(m, lambda v: {_CRC_APPLY.format(v="v", m="m")}) FROM ops WHERE k < 31
    ), entries AS (
        {" UNION ALL ".join(f"SELECT '{n}' AS name, CAST({k} AS BIGINT) AS pos, {_sql_key(k)} || upper(hex(encode({v}))) AS h FROM {n}" for n, (k, v) in _SOURCES.items())}
    ), summed AS (
        SELECT name, pos, len(h) // 2 AS n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
            list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS crc
        FROM entries, bytes
    ), after AS (SELECT name, pos, crc, CAST(coalesce(sum(n) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS n FROM summed),
    moved(name, pos, n, k, crc) AS (
        SELECT name, pos, n, 0, crc FROM after
        UNION ALL SELECT w.name, w.pos, w.n, w.k + 1, CASE WHEN (w.n >> w.k) & 1 = 1 THEN {_CRC_APPLY.format(v="w.crc", m="ops.m")} ELSE w.crc END
        FROM moved AS w JOIN ops ON ops.k = w.k WHERE (w.n >> w.k) > 0
    )
    SELECT name, CAST(bit_xor(crc) AS BIGINT) AS crc FROM moved WHERE (n >> k) = 0 GROUP BY name"""


@query(_CRC)
def q41b_checksum(spark, sf_dir):
    rows = []
    for name, (key, value) in _SOURCES.items():
        t = table(spark, sf_dir, name).select(F.col(key).alias("at"), long_key(F.col(key)).alias("key"), text_key(F.col(value)).alias("value"))
        rows.append((name, checksum(t, "at")))
    return spark.createDataFrame(rows, "name string, crc long")


_EPOCH = "least(event_id // 500, 4)"
_EPOCHS = 5


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events as mutations (seq, key, gone, value, event_type), cut into _EPOCHS batches by time."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), long_key(F.col("user_id")).alias("key"), (F.col("event_type") == "error").alias("gone"),
        text_key(F.col("value").cast("string")).alias("value"), "event_type",
    )
    epoch = F.least(F.floor(F.col("seq") / 500), F.lit(_EPOCHS - 1))
    return [rows.where(epoch == n) for n in range(_EPOCHS)]


def _user_value(df: DataFrame) -> DataFrame:
    return df.select(long_from_key(F.col("key")).alias("user_id"), F.decode("value", "UTF-8").cast("double").alias("value"))


@query(f"SELECT user_id, value FROM (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events WHERE {_EPOCH} <= 2 GROUP BY user_id) AS s WHERE t <> 'error'")
def q42_snapshot_at_epoch(spark, sf_dir):
    """The store as of its third epoch, read after all of them."""
    with _database(spark) as db:
        epochs = []
        for batch in _batches(spark, sf_dir):
            db.tree().apply_batch(batch)
            epochs.append(db.flush().epoch)
        return _user_value(db.tree().collection(epoch=epochs[2]).df)


# the mutations of each epoch that change anything: the last one of each key, unless it leaves what was there
_EFFECTIVE = f"""WITH l AS (SELECT {_EPOCH} AS epoch, user_id, arg_max(event_type, event_id) = 'error' AS gone, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
    p AS (SELECT *, lag(gone) OVER w AS was_gone, lag(value) OVER w AS was FROM l WINDOW w AS (PARTITION BY user_id ORDER BY epoch)),
    e AS (SELECT * FROM p WHERE CASE WHEN gone THEN NOT coalesce(was_gone, true) ELSE coalesce(was_gone, true) OR was IS DISTINCT FROM value END)"""


@query(f"{_EFFECTIVE}, n AS (SELECT epoch, count(*) AS mutations FROM e GROUP BY 1) SELECT 'sum' AS what, CAST(sum(mutations) AS BIGINT) AS mutations, CAST({_EPOCHS} AS BIGINT) AS flushes FROM n UNION ALL SELECT 'max', max(mutations), {_EPOCHS} FROM n")
def q43_flush_stats(spark, sf_dir):
    """Sum and maximum over the flushes of a store, as the store tells them after it was opened again."""
    with _database(spark) as db:
        for batch in _batches(spark, sf_dir):
            db.tree().apply_batch(batch)
            db.flush()
        path = db.config.path
    with Database(spark, path) as db:
        stats = db.stats()
    return spark.createDataFrame([(what, stats[what].mutations, stats["flushes"]) for what in ("sum", "max")], "what string, mutations long, flushes long")


@query(_SNAPSHOT)
def q44_log_compaction(spark, sf_dir):
    """The state after five epochs, their compaction into a new base, and a vacuum of all that is old."""
    with _database(spark, keep_versions=1) as db:
        for batch in _batches(spark, sf_dir):
            db.tree().apply_batch(batch)
            db.flush()
        if db.compact(force=True) != 1 or db.vacuum() <= 0 or db.stats()["collections"]["1"]["deltas"]:
            raise StoreError("nothing was compacted")
        return _user_value(db.tree().collection().df)


_LEAF = 1024


@query("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(0 AS BIGINT) AS oversized, CAST(0 AS BIGINT) AS overlaps FROM orders")
def q45_leaves(spark, sf_dir):
    """The files of a base of at most 1024 entries each: what they hold, how many are larger, how many overlap the one before."""
    with _database(spark, rows_per_file=_LEAF) as db:
        db.tree().insert(_entries(spark, sf_dir, "orders"))
        db.flush()
        db.compact(force=True)
        leaves = db.files_of().withColumn("before", F.lag("hi").over(Window.orderBy("lo")))  # one row a file
        count = lambda c: F.count_if(c)
        return leaves.agg(F.sum("n").alias("n"), long_from_key(F.min("lo")).alias("lo"), long_from_key(F.max("hi")).alias("hi"), count(F.col("n") > _LEAF).alias("oversized"), count(F.col("before") >= F.col("lo")).alias("overlaps"))


@query("SELECT 'whole' AS what, true AS valid, count(*) AS n FROM orders UNION ALL SELECT 'doubled', false, count(*) + 1 FROM orders")
def q46_validate(spark, sf_dir):
    """A store is valid; with a copy of one entry put into its base behind its back it is not."""
    out = []
    with _database(spark) as db:
        db.tree().insert(_entries(spark, sf_dir, "orders"))
        db.flush()
        db.compact(force=True)
        for what in ("whole", "doubled"):
            base = f"{db.config.path}/{db.state['collections']['1']['base']}"
            if what == "doubled":
                spark.read.parquet(base).orderBy("key").limit(1).write.mode("append").parquet(base)
            try:
                db.validate()
                valid = True
            except StoreError:
                valid = False
            out.append((what, valid, db.tree().collection().df.count()))
    return spark.createDataFrame(out, "what string, valid boolean, n long")


_BY_TYPE = f"""WITH l AS (SELECT event_type, {_EPOCH} AS epoch, user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3),
    p AS (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY epoch) AS was FROM l)"""


@query(f"{_BY_TYPE} SELECT * FROM (SELECT event_type, count(DISTINCT user_id) AS live, count(*) FILTER (WHERE was IS DISTINCT FROM value) AS total FROM p GROUP BY 1) AS s WHERE live < 0.9 * total")
def q47_defrag_candidates(spark, sf_dir):
    """Of one collection for each type of event: those in which too few of the stored rows are live."""
    with _database(spark) as db:
        batches = _batches(spark, sf_dir)
        types = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())
        for batch in batches:
            for kind in types:
                db.tree(kind.encode()).apply_batch(batch.where(F.col("event_type") == kind).withColumn("gone", F.lit(False)).drop("event_type"))
            db.flush()
        of = {db.tree(kind.encode()).id: kind for kind in types}
        found = db.defrag_candidates()
    return spark.createDataFrame([(of[i], live, total) for i, live, total in found], "event_type string, live long, total long")


@query("SELECT 'orders' AS name, count(*) AS n, true AS adds_up, true AS shrinks FROM orders")
def q48_size_on_disk(spark, sf_dir):
    """The size of a store is that of its files, and a vacuum after a rewrite gives its space back."""
    with _database(spark, keep_versions=1) as db:
        t = db.tree(b"orders")
        t.insert(_entries(spark, sf_dir, "orders"))
        db.flush()
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{db.config.path}/data").agg(F.sum("length")).first()[0]
        adds_up = files + db.files.bytes("_manifest") + db.files.bytes("_lock") <= db.size_on_disk() < 2 * files + 100_000
        t.update_and_fetch(t.collection().keys(), lambda old: F.concat(old, F.lit(b"+")))
        db.flush()
        before = db.size_on_disk()
        db.compact()
        shrinks = db.vacuum() > 0 and db.size_on_disk() < before
        return spark.createDataFrame([("orders", t.collection().df.count(), adds_up, shrinks)], "name string, n long, adds_up boolean, shrinks boolean")


@query(_SNAPSHOT)
def q51_recovery(spark, sf_dir):
    """A store that was left with a torn manifest and data that no manifest names opens as of its last commit."""
    batches = _batches(spark, sf_dir)
    db = _database(spark)
    for batch in batches:
        db.tree().apply_batch(batch)
        db.flush()
    db.tree().apply_batch(batches[0])
    db._write(db.tree()._pending_log(99), "data/1/epoch-99-never-published", sort=["key"])
    db.files.create("_manifest/00000099.json", '{"crc": 1, "state": ')
    db.close(flush=False)
    with Database(spark, db.config.path) as again:
        if not again.was_recovered():
            raise StoreError("nothing was recovered")
        again.vacuum()
        return _user_value(again.tree().collection().df)


@query("SELECT * FROM (VALUES ('second open', true), ('flush after failure', true), ('conflict', true), ('format', true), ('unlocked', true)) AS t(what, refused)")
def q52_refusals(spark, sf_dir):
    """What a store refuses: a second owner, work after a failed flush, a version that another writer took, a format it doesn't know; not a new owner."""

    def refused(f: Callable, kind: type[Exception] = StoreError) -> bool:
        try:
            f()
        except kind:
            return True
        return False

    db = _database(spark)
    out = [("second open", refused(lambda: Database(spark, db.config.path)))]
    db.tree().insert(_entries(spark, sf_dir, "customer").withColumn("value", F.raise_error(F.lit("broken on purpose")).cast("binary")))
    failed = refused(db.flush, Exception)
    out.append(("flush after failure", failed and refused(db.flush)))
    db.close(flush=False)
    with Database(spark, db.config.path) as db:
        unlocked = True
    db = Database(spark, db.config.path)
    db.tree().insert(_entries(spark, sf_dir, "customer"))
    db.files.create(f"_manifest/{db.version + 1:08d}.json", "{}")
    out.append(("conflict", refused(db.flush, Conflict)))
    db.close(flush=False)
    state = {"format": 99, "entry": "?"}
    db.files.create("_manifest/00000050.json", json.dumps({"crc": zlib.crc32(json.dumps(state, sort_keys=True).encode()), "state": state}))
    out += [("format", refused(lambda: Database(spark, db.config.path))), ("unlocked", unlocked)]
    return spark.createDataFrame(out, "what string, refused boolean")


@query("SELECT upper(hex(encode(CAST(user_id AS VARCHAR)))) AS key, upper(hex(encode(t))) AS value FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) AS s WHERE t <> 'error'")
def q49_stream_ingest(spark, sf_dir):
    at = _place(spark, "stream")
    stream = _stream(spark, sf_dir, "events")
    rows = stream.select(F.col("event_id").alias("seq"), text_key(F.col("user_id").cast("string")).alias("key"), (F.col("event_type") == "error").alias("gone"), text_key(F.col("event_type")).alias("value"))
    db = Database(spark, f"{at}/db")
    with db:
        ingest(rows, db, "events", f"{at}/checkpoint").awaitTermination()
        return db.tree().collection().df.select(F.hex("key").alias("key"), F.hex("value").alias("value"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream.  Streams read folders: a table of one file is picked from its folder by name."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if Files(spark, sf_dir).names(f"{name}.parquet") == [f"{name}.parquet"]:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _updates(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows that an update stream gave, with the number of their batch."""
    at = _place(spark, "updates")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("step", F.lit(batch_id)).write.mode("overwrite").parquet(f"{at}/out/{batch_id:08d}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out/*")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def q50_stream_counter(spark, sf_dir):
    updates = _updates(spark, counters(_stream(spark, sf_dir, "events"), "user_id"))
    return mutations.latest(updates, "user_id", "step", ["n"])


@query(_CAS + " SELECT user_id, event_id, ok, previous, proposed, cur AS current FROM r")
def q53_stream_registers(spark, sf_dir):
    stream = _cas_of(_stream(spark, sf_dir, "events"))
    return _updates(spark, registers(stream, "user_id", "event_id", "expected", "new")).withColumnRenamed("seq", "event_id").drop("step")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
