"""Store: commits, recovery, crash before publishing, conflicts, catalog, export, compaction, streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lexistore.sources.store import Config, Conflict, Database, StoreError
from lexistore.streaming.ingest import ingest, registers

ENTRY = "key binary, value binary"


def entries(spark, items):
    return spark.createDataFrame(list(items.items()), ENTRY)


def content(tree):
    return {bytes(k): bytes(v) for k, v in tree.collection().df.collect()}


def test_commit_recover_and_read_your_writes(spark, tmp_path):
    at = f"file://{tmp_path}/db"
    with Database(spark, at) as db:
        assert not db.was_recovered()
        t = db.tree()
        assert [r.previous for r in t.insert(entries(spark, {b"a": b"1", b"": b""})).collect()] == [None, None]
        assert content(t) == {b"a": b"1", b"": b""}
        stats = db.flush()
        assert (stats.mutations, db.state["epoch"]) == (2, 2)
        old = {bytes(r.key): r.previous for r in t.remove(spark.createDataFrame([(b"a",), (b"zz",)], "key binary")).collect()}
        assert bytes(old[b"a"]) == b"1" and old[b"zz"] is None
    with Database(spark, at) as db:
        assert db.was_recovered() and content(db.tree()) == {b"": b""}
        assert {bytes(k): bytes(v) for k, v in db.tree().collection(epoch=2).df.collect()} == {b"a": b"1", b"": b""}
        db.validate()


def test_data_without_manifest_never_happened(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/db"
    with Database(spark, at) as db:
        db.tree().insert(entries(spark, {b"k": b"old"}))
    db = Database(spark, at)
    db.tree().insert(entries(spark, {b"k": b"new", b"j": b"new"}))
    monkeypatch.setattr(db, "_publish", lambda state: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        db.flush()
    with pytest.raises(StoreError):
        db.flush()  # the first failure sticks
    db.close()
    (tmp_path / "db/_manifest/00000099.json").write_text('{"crc": 1, "state": ')  # torn
    with Database(spark, at) as db:
        assert content(db.tree()) == {b"k": b"old"}
        db.tree().insert(entries(spark, {b"j": b"x"}))
    with Database(spark, at) as db:
        assert content(db.tree()) == {b"k": b"old", b"j": b"x"}
        db.vacuum()
        assert content(db.tree()) == {b"k": b"old", b"j": b"x"}


def test_lock_conflict_and_format(spark, tmp_path):
    at = f"file://{tmp_path}/db"
    db = Database(spark, at)
    with pytest.raises(StoreError):
        Database(spark, at)
    db.files.create("_manifest/00000001.json", "{}")
    db.tree().insert(entries(spark, {b"a": b"1"}))
    with pytest.raises(Conflict):
        db.flush()
    db.close(flush=False)
    state = {"format": 99, "entry": ENTRY}
    from lexistore.sources.store import _hash

    db.files.create("_manifest/00000002.json", json.dumps({"crc": _hash(state), "state": state}))
    with pytest.raises(StoreError):
        Database(spark, at)


def test_catalog_export_import(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/a") as db:
        for n in range(3):
            db.tree(b"tree %d" % n).insert(entries(spark, {b"%d" % i: b"%d" % n for i in range(4)}))
        db.tree().insert(entries(spark, {b"d": b"d"}))
        db.flush()
        assert db.drop_tree(b"tree 2") and not db.drop_tree(b"tree 2") and not db.contains_tree(b"tree 2")
        db.export(f"{tmp_path}/out")
    with Database(spark, f"file://{tmp_path}/a") as db:
        assert db.tree_names() == [b"tree 0", b"tree 1"] and content(db.tree(b"tree 2")) == {}
        sums = [db.tree(n).collection().checksum() for n in (None, b"tree 0", b"tree 1")]
    with Database(spark, f"file://{tmp_path}/b") as db:
        db.import_(f"{tmp_path}/out")
        assert [db.tree(n).collection().checksum() for n in (None, b"tree 0", b"tree 1")] == sums
        with pytest.raises(StoreError):
            db.import_(f"{tmp_path}/out")


def test_compaction_and_space(spark, tmp_path):
    with Config(f"file://{tmp_path}/db", keep_versions=1).open(spark) as db:
        t = db.tree()
        for i in range(5):
            t.insert(entries(spark, {b"k%03d" % k: b"%d" % i for k in range(50)}))
            db.flush()
        before = content(t)
        assert db.compact() == 1 and content(t) == before
        assert db.vacuum() > 0 and content(t) == before
        stats = db.stats()
        assert stats["collections"]["1"] == {"rows": 50, "deltas": 0, "delta_rows": 0} and stats["sum"].mutations == 250 and stats["max"].mutations == 50
        assert db.size_on_disk() > 0 and db.files_of().agg(F.sum("n")).first()[0] == 50
        t.clear()
        assert content(t) == {}


def test_writes_against_a_model(spark, tmp_path):
    rnd = random.Random(3)
    key = lambda: b"%d" % rnd.randint(0, 9)
    model = {}
    with Database(spark, f"file://{tmp_path}/db") as db:
        t = db.tree()
        for _ in range(3):
            batch = [(i, key(), rnd.random() < 0.3, b"%d" % i) for i in range(15)]
            t.apply_batch(spark.createDataFrame(batch, "seq long, key binary, gone boolean, value binary"))
            for _, k, gone, v in batch:
                model.pop(k, None) if gone else model.__setitem__(k, v)
            ops = [(i, key(), rnd.choice([None, model.get(b"1")]), rnd.choice([None, b"c"])) for i in range(10)]
            done = {r.seq: (r.ok, r.previous) for r in t.compare_and_swap(spark.createDataFrame(ops, "seq long, key binary, expected binary, new binary")).collect()}
            for i, k, e, n in ops:
                held = model.get(k)
                assert done[i] == (held == e, held)
                if held == e:
                    model.pop(k, None) if n is None else model.__setitem__(k, n)
            db.flush()
            popped = [bytes(r.key) for r in t.pop_first(2).collect()]
            assert popped == sorted(model)[:2]
            for k in popped:
                del model[k]
            keys = spark.createDataFrame([(b"5",), (b"x",)], "key binary")
            t.update_and_fetch(keys, lambda old: F.concat(F.coalesce(old, F.lit(b"")), F.lit(b"+")))
            for k in (b"5", b"x"):
                model[k] = model.get(k, b"") + b"+"
            assert content(t) == model
            db.flush()


def test_stream_batches_commit_once(spark, tmp_path):
    log = spark.createDataFrame([(i, b"%d" % (i % 3), i % 5 == 0, b"%d" % i) for i in range(30)], "seq long, key binary, gone boolean, value binary")
    log.write.parquet(f"{tmp_path}/in")
    wanted = {}
    for i in range(30):
        wanted.pop(b"%d" % (i % 3), None) if i % 5 == 0 else wanted.__setitem__(b"%d" % (i % 3), b"%d" % i)
    with Database(spark, f"file://{tmp_path}/db") as db:
        for run in range(2):  # the second time the same batch comes with no memory of the first
            ingest(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), db, "s", f"{tmp_path}/checkpoint{run}").awaitTermination()
            assert content(db.tree()) == wanted and db.state["epoch"] == 2


def test_equal_values_write_nothing_and_repeated_keys_are_settled(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db") as db:
        t = db.tree()
        twice = spark.createDataFrame([(b"a", b"1"), (b"b", b"2"), (b"a", b"3")], ENTRY)
        t.insert(twice)
        assert db.flush().mutations == 2 and content(t) == {b"a": b"3", b"b": b"2"}
        epoch = db.state["epoch"]
        for _ in range(2):
            t.insert(entries(spark, {b"a": b"3", b"b": b"2"}))
            assert db.flush().mutations == 0
        assert db.stats()["collections"]["1"]["deltas"] == 1 and db.state["epoch"] == epoch + 2


def test_totals_last_and_the_flusher_flushes(spark, tmp_path):
    at = f"file://{tmp_path}/db"
    with Config(at, flush_every=0.2, flush_on_close=False).open(spark) as db:
        db.tree().insert(entries(spark, {b"a": b"1"}))
        deadline = time.time() + 60
        while db.stats()["flushes"] < 1 and time.time() < deadline:
            time.sleep(0.1)
    with Database(spark, at) as db:
        assert content(db.tree()) == {b"a": b"1"}
        db.tree().insert(entries(spark, {b"b": b"1", b"c": b"1"}))
        db.flush()
    with Database(spark, at) as db:
        stats = db.stats()
        assert (stats["flushes"], stats["sum"].mutations, stats["max"].mutations) == (2, 3, 2)


def test_a_failure_in_the_background_is_reported(spark, tmp_path):
    db = Config(f"file://{tmp_path}/db", flush_every=0.1).open(spark)
    db.tree().insert(entries(spark, {b"a": b"1"}).withColumn("value", F.raise_error(F.lit("no")).cast("binary")))
    db._flusher.join(60)
    with pytest.raises(StoreError):
        db.flush()
    db.close()


def test_an_import_in_conflict_changes_nothing(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/a") as db:
        db.tree(b"new").insert(entries(spark, {b"n": b"1"}))
        db.tree(b"old").insert(entries(spark, {b"a": b"1", b"b": b"2"}))
        db.export(f"{tmp_path}/out")
    with Database(spark, f"file://{tmp_path}/b") as db:
        db.tree(b"old").insert(entries(spark, {b"b": b"0"}))
        db.flush()
        assert [(bytes(r.name), bytes(r.key)) for r in db.conflicts(f"{tmp_path}/out").collect()] == [(b"old", b"b")]
        with pytest.raises(StoreError):
            db.import_(f"{tmp_path}/out")
        assert not db.contains_tree(b"new") and content(db.tree(b"old")) == {b"b": b"0"}


def test_stream_registers(spark, tmp_path):
    ops = [(i, i % 3, None if i % 4 == 0 else i % 5, i % 5 if i % 7 else None) for i in range(60)]
    for part in range(2):
        spark.createDataFrame(ops[30 * part : 30 * part + 30], "seq long, key long, e long, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    held, wanted = {}, []
    for seq, key, e, n in ops:
        before = held.get(key)
        if before == e:
            held[key] = n
        wanted.append((key, seq, before == e, before, n, held.get(key)))
    stream = spark.readStream.schema("seq long, key long, e long, n long").parquet(f"{tmp_path}/in")
    out = registers(stream, "key", "seq", "e", "n")
    out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=lambda r: r[1]) == wanted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many(spark, n):
    """Entries with keys in sequence, of which many rows make a small file."""
    return spark.range(n).select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), F.lit(b"v").alias("value"))


def test_a_collection_is_never_broadcast(spark, tmp_path):
    n = 70_000
    with Database(spark, f"file://{tmp_path}/db") as db:
        t = db.tree(b"t")
        t.insert(many(spark, n))
        db.flush()
        assert db.files.bytes("data") < 10 << 20  # small enough for Spark to broadcast the keys by the files' size
        held = t.collection().df
        assert "Broadcast" not in plan(held) and held.count() == n
        t.insert(many(spark, 2 * n).withColumn("value", F.lit(b"w")))
        assert "Broadcast" not in plan(t.pending[0])
        both = t.collection().df
        assert "Broadcast" not in plan(both) and both.where("value = X'77'").count() == both.count() == 2 * n
        db.export(f"file://{tmp_path}/out", default=False)
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2 * n


def test_an_import_broadcasts_no_collection(spark, tmp_path):
    n, out = 70_000, f"file://{tmp_path}/out"
    with Database(spark, f"file://{tmp_path}/a") as a:
        a.tree(b"t").insert(many(spark, n))
        a.export(out, default=False)
    with Database(spark, f"file://{tmp_path}/b") as b:
        b.import_(out)
        found = b.conflicts(out)
        assert "Broadcast" not in plan(found) and found.count() == n
        b.compact(force=True)
        assert "Broadcast" not in plan(b.conflicts(out)) and b.tree(b"t").collection().df.count() == n


def test_rewrites_of_a_whole_collection_broadcast_none(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db") as db:
        t = db.tree()
        t.insert(many(spark, 70_000))
        db.flush()
        held = t.collection().keys()
        given = [t.update_and_fetch(held, lambda v: F.concat(v, F.lit(b"+"))), t.fetch_and_update(held, lambda v: v), t.remove(held), t.insert(many(spark, 70_000))]
        swaps = t.compare_and_swap(held.select(F.lit(1).alias("seq"), "key", F.lit(b"v").alias("expected"), F.lit(b"w").alias("new")))
        assert not [x for x in (*given, *t.pending, swaps) if "Broadcast" in plan(x)]
        t.pending.clear()


def test_a_check_of_a_store_broadcasts_no_collection(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db") as db:
        t = db.tree()
        t.insert(many(spark, 70_000))
        db.flush()
        assert "Broadcast" not in plan(t.collection().duplicates())
        db.validate()
