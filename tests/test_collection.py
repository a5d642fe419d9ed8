"""Golden tests of reads, replay, pops, checksum, codec and bounds."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lexistore.functions.bounds import Excluded, Included, Unbounded, prefix_range, text_prefix_range
from lexistore.functions.codec import composite, long_from_key, long_key, terminated, text_key
from lexistore.operators import mutations, pops
from lexistore.operators.checksum import checksum, combine
from lexistore.operators.collection import Collection

ENTRY = "key binary, value binary"


def collection(spark, entries):
    return Collection(spark.createDataFrame([(bytes(k), bytes(v)) for k, v in entries], ENTRY))


def rows(df):
    return [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()]


def test_prefix_range():
    assert prefix_range(b"") == (Included(b""), Unbounded)
    assert prefix_range(b"\xff\xff") == (Included(b"\xff\xff"), Unbounded)
    assert prefix_range(b"\x01\xff") == (Included(b"\x01\xff"), Excluded(b"\x02"))
    assert text_prefix_range("ab") == (Included("ab"), Excluded("ac"))
    assert text_prefix_range("a\U0010ffff") == (Included("a\U0010ffff"), Excluded("b"))


def test_strict_neighbours(spark):
    c = collection(spark, [(bytes([i]), b"v") for i in range(10)])
    below = {b"": None, b"\0": None, b"\1": 0, b"\x08": 7, b"\x09": 8, b"\x0a": 9, b"\xff": 9}
    above = {b"": 0, b"\0": 1, b"\1": 2, b"\x08": 9, b"\x09": None, b"\x0a": None, b"\xff": None}
    probes = spark.createDataFrame([(k,) for k in [*below, *below]], "p binary")
    for wanted, many, one in ((below, c.get_lt_many, c.get_lt), (above, c.get_gt_many, c.get_gt)):
        for buckets in (1, 3):
            got = rows(many(probes, "p", buckets).select("p", "key"))
            assert len(got) == 2 * len(wanted)
            assert dict(got) == {p: None if k is None else bytes([k]) for p, k in wanted.items()}
        assert [k for k, _ in rows(one(b"\x08"))] == [bytes([wanted[b"\x08"]])]


def test_empty_key_and_ranges(spark):
    c = collection(spark, [(b"", b"")] + [(b"%d" % i, b"") for i in range(6)])
    assert rows(c.first())[0][0] == b"" and rows(c.get_lt(b"")) == []
    assert rows(c.get_gt(b""))[0][0] == b"0"
    keys = lambda df: [k for k, _ in rows(df)]
    assert keys(c.range(Included(b"2"), Excluded(b"4"), reverse=False)) == [b"2", b"3"]
    assert keys(c.range(Included(b"2"), Unbounded, reverse=True)) == [b"5", b"4", b"3", b"2"]
    assert keys(c.range(Unbounded, Included(b"2"), reverse=True)) == [b"2", b"1", b"0", b""]
    assert keys(c.range(Included(b"4"), Excluded(b"2"))) == []
    assert c.contains_key(b"") and not c.contains_key(b"9") and not c.is_empty()


def test_range_and_prefix_are_pushed_down(spark, tmp_path):
    collection(spark, [(b"a", b"1"), (b"ab", b"2"), (b"b", b"3")]).df.write.parquet(str(tmp_path / "t"))
    c = Collection(spark.read.parquet(str(tmp_path / "t")))
    plan = c.scan_prefix(b"a")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert sorted(k for k, _ in rows(c.scan_prefix(b"a"))) == [b"a", b"ab"]


def test_pops(spark):
    c = collection(spark, [(bytes([i]), bytes([10 * i])) for i in range(6)])
    popped, rest = pops.pop_first(c, 2)
    assert [k for k, _ in rows(popped)] == [b"\0", b"\1"] and rest.df.count() == 4
    popped, rest = pops.pop_last(c, 1, Included(b"\1"), Excluded(b"\4"))
    assert [k for k, _ in rows(popped)] == [b"\3"] and rest.df.count() == 5
    assert rows(pops.pop_last(c, 1, Unbounded, Excluded(b"\0"))[0]) == []
    assert pops.clear(c).is_empty()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_checksum(spark, n):
    rnd = random.Random(n)
    entries = sorted({rnd.randbytes(rnd.randint(0, 6)): rnd.randbytes(3) for _ in range(n)}.items())
    assert collection(spark, entries).checksum() == zlib.crc32(b"".join(k + v for k, v in entries))
    assert combine(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_checksum_of_nulls_and_equal_keys(spark):
    rows = [(None, b"v"), (b"a", None), (b"b", b"2"), (b"a", b"1"), (None, None)]
    wanted = zlib.crc32(b"v" + b"a" + b"a1" + b"b2")
    for n in (1, 3):
        assert checksum(spark.createDataFrame(rows, ENTRY).repartition(n).withColumn("o", F.col("key")), "o") == wanted


def test_neighbours_over_many_ranges(spark):
    entries = spark.range(3000).select((F.col("id") * 7).alias("key"), F.hex("id").alias("value"))
    probes = spark.range(-5, 21_020).select(F.col("id").alias("p"))
    c = Collection(entries)
    for buckets in (None, 200):
        below = {r.p: (r.key, r.value) for r in c.get_lt_many(probes, "p", buckets).collect()}
        above = {r.p: (r.key, r.value) for r in c.get_gt_many(probes, "p", buckets).collect()}
        for p in range(-5, 21_020):
            lt, gt = min((p - 1) // 7, 2999), max(p // 7 + 1, 0)
            assert below[p] == ((lt * 7, f"{lt:X}") if lt >= 0 else (None, None)), p
            assert above[p] == ((gt * 7, f"{gt:X}") if gt < 3000 else (None, None)), p


def test_ranges_grow_with_the_entries(spark, monkeypatch):
    from lexistore.operators import neighbours

    df = spark.range(20_000).select(F.col("id").alias("key"))
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 100)
    splits = neighbours.split_points(df, "key")
    assert 150 < len(splits) < 200
    sizes = df.groupBy(neighbours.range_of(F.col("key"), splits).alias("r")).count().collect()
    assert len(sizes) == len(splits) + 1 and max(r["count"] for r in sizes) < 600
    assert all(r.n == sum(x <= r.key for x in splits) for r in df.select("key", neighbours.range_of(F.col("key"), splits).alias("n")).where("key % 97 = 0").collect())


def test_dump(spark):
    c = collection(spark, [(b"b", b"2"), (b"a", b"1"), (b"c", b"3")])
    assert c.dump(2).split("\n")[2] == "..." and "a" in c.dump(2).split("\n")[0] and "..." not in c.dump(3)


def test_enumerate(spark):
    c = Collection(spark.range(1000).select((F.col("id") * 7 % 1000).alias("key")))
    assert c.enumerate("n", 7).where("n != key").count() == 0


def test_codec_order(spark):
    values = [-(2**63), -300, -1, 0, 1, 255, 256, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", long_key(F.col("v")).alias("k"))
    assert [r.v for r in df.orderBy("k").collect()] == values
    assert df.where(long_from_key(F.col("k")) != F.col("v")).count() == 0
    pairs = sorted((a, b) for a in ("", "a", "a\0", "a\0b", "ab") for b in (-1, 2))
    keyed = spark.createDataFrame(pairs, "a string, b long").select("a", "b", composite(terminated(text_key(F.col("a"))), long_key(F.col("b"))).alias("k"))
    assert [(r.a, r.b) for r in keyed.orderBy("k").collect()] == pairs


def _cas_model(ops):
    state, out = {}, []
    for seq, key, e, n in ops:
        held = state.get(key)
        if held == e:
            state[key] = n
        out.append((key, seq, held == e, held, n, state.get(key)))
    return out


@pytest.mark.parametrize("width", [3, 1000])
def test_compare_and_swap_against_a_model(spark, width):
    rnd = random.Random(width)
    values = [None, 1, 2]
    ops = [(i, rnd.choice("aaab"), rnd.choice(values), rnd.choice(values)) for i in range(300)]
    log = spark.createDataFrame(ops, "seq long, key string, e long, n long")
    got = mutations.compare_and_swap(log, "key", "seq", "e", "n", width).select("key", "seq", "ok", "previous", "proposed", "current")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == _cas_model(ops)


def test_compare_and_swap_of_a_hot_key_with_distinct_values(spark):
    rnd = random.Random(9)
    ops = [(i, "hot", rnd.choice([i - 1, rnd.randint(0, 16_000)]) if i else None, i) for i in range(16_000)]
    log = spark.createDataFrame(ops, "seq long, key string, e long, n long")
    mutations.compare_and_swap(log.limit(10), "key", "seq", "e", "n").collect()
    began = time.time()
    got = mutations.compare_and_swap(log, "key", "seq", "e", "n").select("key", "seq", "ok", "previous", "proposed", "current").collect()
    assert time.time() - began < 15 and sorted(map(tuple, got), key=lambda r: r[1]) == _cas_model(ops)


def test_compare_and_swap_of_null_keys_and_binary_values(spark):
    ops = [(1, None, None, b"a"), (2, b"k", b"x", b"y"), (3, None, b"a", None), (4, None, None, b""), (5, b"k", None, b"z")]
    log = spark.createDataFrame(ops, "seq long, key binary, e binary, n binary")
    got = mutations.compare_and_swap(log, "key", "seq", "e", "n", 2).select("key", "seq", "ok", "previous", "proposed", "current")
    assert sorted(rows(got), key=lambda r: r[1]) == _cas_model(ops)
    assert mutations.compare_and_swap(log.limit(0), "key", "seq", "e", "n").count() == 0


@pytest.mark.parametrize("width", [4, 1000])
def test_running_results_in_slices(spark, width):
    rnd = random.Random(1)
    ops = [(i, rnd.choice("aaab"), rnd.choice([None, 5, 6])) for i in range(200)]
    log = spark.createDataFrame(ops, "seq long, key string, v long")
    held, counts = {}, {}
    wanted = []
    for i, k, v in ops:
        counts[k] = counts.get(k, 0) + 1
        wanted.append((i, held.get(k), counts[k], counts[k] - 1 or None))
        held[k] = v
    before = mutations.previous(log, "key", "seq", F.col("v"), width=width)
    assert sorted((r.seq, r.previous) for r in before.collect()) == [(i, p) for i, p, _, _ in wanted]
    counted = mutations.running_count(log, "key", "seq", width=width)
    assert sorted((r.seq, r.new, r.old) for r in counted.collect()) == [(i, n, o) for i, _, n, o in wanted]


def test_fold_by_rows_against_a_model(spark):
    rnd = random.Random(4)
    ops = [(i, rnd.choice([None, "a", "b"]), rnd.randint(0, 9)) for i in range(300)]
    log = spark.createDataFrame(ops, "seq long, key string, v long").repartition(3)
    step = lambda held, row: ((held or 1) * 3 % 101 + row["v"], (row["seq"], held))
    held, wanted = {}, []
    for i, k, v in ops:
        wanted.append((k, i, held.get(k)))
        held[k] = (held.get(k) or 1) * 3 % 101 + v
    assert sorted(map(tuple, mutations.fold_rows(log, "key", "seq", step, "seq long, before long").collect()), key=lambda r: r[1]) == wanted


def test_replay_and_overlay_against_a_model(spark):
    rnd = random.Random(5)
    ops = [(i, rnd.randint(0, 20), rnd.random() < 0.3, rnd.randint(0, 3)) for i in range(400)]
    model = {}
    for _, k, gone, v in ops:
        if gone:
            model.pop(k, None)
        else:
            model[k] = v
    log = spark.createDataFrame(ops, "seq long, key long, gone boolean, value long")
    assert dict(map(tuple, mutations.replay(log, "key", "seq", ["value"], F.col("gone")).collect())) == model
    base = spark.createDataFrame([(k, 9) for k in range(5)], "key long, value long")
    batch = mutations.dedupe_batch(log, "key", "seq", ["gone", "value"])
    over = {**{k: 9 for k in range(5)}}
    for _, k, gone, v in ops:
        over[k] = v
        if gone:
            over.pop(k)
    assert dict(map(tuple, mutations.overlay(base, batch, "key", "gone").collect())) == over
    probes = spark.createDataFrame([(1,), (99,)], "key long")
    assert {r.key: r.status for r in mutations.batch_get(probes, batch, "key", "gone").collect()}[99] == "absent"


def test_effective_drops_idle_operations(spark):
    snapshot = spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string")
    batch = spark.createDataFrame([(1, "a", False), (2, "c", False), (3, None, True), (1, None, True)], "key long, value string, gone boolean")
    kept = mutations.effective(snapshot, batch, "key", "value", "gone").collect()
    assert sorted((r.key, r.gone) for r in kept) == [(1, True), (2, False)]


def test_compare_and_swap_deals_its_log_twice_and_carries_slices_over_batches(spark):
    rnd = random.Random(12)
    ops = [(i, rnd.choice(["a", "a", "a", None, "b"]), rnd.choice([None, "x", "y"]), rnd.choice([None, "x", "y"])) for i in range(500)]
    log = spark.createDataFrame(ops, "seq long, key string, e string, n string").repartition(5)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        done = mutations.compare_and_swap(log, "key", "seq", "e", "n", 60)
        got = done.select("key", "seq", "ok", "previous", "proposed", "current").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == _cas_model(ops)
    plan = mutations.compare_and_swap(spark.range(9).selectExpr("id as seq", "id as key", "id as e", "id as n"), "key", "seq", "e", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 3  # the log for its maps and for its outcomes, and the maps


def test_cas_state_needs_no_join_and_agrees_with_a_model(spark):
    rnd = random.Random(13)
    ops = [(i, rnd.choice("aab"), rnd.choice([None, 1, 2]), rnd.choice([None, 1, 2])) for i in range(200)]
    state = mutations.cas_state(mutations.compare_and_swap(spark.createDataFrame(ops, "seq long, key string, e long, n long"), "key", "seq", "e", "n", 30), "key")
    last = {key: current for key, _, _, _, _, current in _cas_model(ops)}
    assert "Join" not in state._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, state.collect())) == {k: v for k, v in last.items() if v is not None}
