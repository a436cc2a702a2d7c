"""The reference behaviours of a key-value store, on literal logs and on random ones."""

import random

import pytest

from tidelog.operators import mutations as m
from tidelog.operators.runs import RunStore, block_ranges, floor_block, may_drop, merge, pick_tier

SCHEMA = "key string, lsn long, tombstone boolean, value string"


def log(spark, *rows):
    return spark.createDataFrame([(k, i, v is None, v) for i, (k, v) in enumerate(rows, 1)], SCHEMA)


def live(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_put_overwrite_delete(spark):
    d = log(spark, ("k", "v1"), ("k", "v2"), ("gone", "x"), ("gone", None), ("never", None), ("empty", ""))
    assert live(m.materialize(d)) == {"k": "v2", "empty": ""}
    assert live(m.get(d, "k")) == {"k": "v2"}
    assert live(m.get(d, "missing")) == {}
    assert [tuple(r) for r in m.lookup(d, "gone").collect()] == [(True, True, None)]
    assert [tuple(r) for r in m.lookup(d, "missing").collect()] == [(False, False, None)]
    assert m.key_count(d).first()["live_keys"] == 2
    assert {r["key"] for r in m.tombstones(d).collect()} == {"gone", "never"}


def test_byte_order(spark):
    d = log(spark, ("key-2", "a"), ("key-10", "b"), ("é", "c"), ("z", "d"))
    assert [r["key"] for r in m.ordered_scan(d).collect()] == ["key-10", "key-2", "z", "é"]
    assert [r["key"] for r in m.ordered_scan(d, "key-2", "z").collect()] == ["key-2"]


def test_buffer_size_counts_the_newest_value(spark):
    assert m.buffer_size(log(spark, ("k", "1234"))).first()["bytes"] == 5
    assert m.buffer_size(log(spark, ("k", "1234"), ("k", "12"))).first()["bytes"] == 3


def test_key_count_over_runs(spark):
    a, b, c = log(spark, ("f", "v1")), log(spark, ("f", "v1"), ("f", "v2")), log(spark, ("f", "v1"), ("f", "v2"), ("f", None))
    for d, n in ((a, 1), (b, 1), (c, 0)):
        assert m.key_count(d).first()["live_keys"] == n


def test_as_of_and_base_plus_tail(spark):
    d = log(spark, ("a", "1"), ("b", "1"), ("a", None), ("b", "2"), ("c", "1"))
    assert live(m.as_of(d, 2)) == {"a": "1", "b": "1"}
    assert live(m.base_plus_tail(m.as_of(d, 2), d, 2)) == live(m.materialize(d)) == {"b": "2", "c": "1"}


def test_empty_log(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert m.materialize(d).count() == 0
    assert m.key_count(d).first()["live_keys"] == 0


def test_point_get_pushes_the_key_to_the_scan(spark, tmp_path):
    log(spark, ("a", "1"), ("b", "2")).write.parquet(f"{tmp_path}/log")
    plan = m.get(spark.read.parquet(f"{tmp_path}/log"), "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan
    plan = m.key_count(spark.read.parquet(f"{tmp_path}/log"))._jdf.queryExecution().executedPlan().toString()
    assert "value:string" not in plan


def test_tombstone_hides_an_older_run(spark, tmp_path):
    s = RunStore(spark, f"{tmp_path}/s")
    d = log(spark, ("k", "v1"), ("k", None))
    s.flush(d.where("lsn = 1"))
    s.flush(d.where("lsn = 2"))
    assert live(m.materialize(s.read())) == {}


def test_compaction_drops_tombstones_only_at_the_bottom(spark, tmp_path):
    s = RunStore(spark, f"{tmp_path}/s")
    d = log(spark, ("doomed", "v0"), ("doomed", None), ("k1", "v1"), ("k2", "v2"))
    for i in range(1, 5):
        s.flush(d.where(f"lsn = {i}"))
    assert s.compact() == 1
    assert [g for g, _ in s.manifest.live()] == [1]
    assert {r["key"] for r in s.read().collect()} == {"k1", "k2"}
    assert s.clean() == []  # too young: they may be of a writer that has not published yet
    assert len(s.clean(0)) == 4 and s.on_disk() == s.manifest.live()
    more = log(spark, *[("x", str(i)) for i in range(4)], ("k1", None))
    for i in range(2, 6):
        s.flush(more.where(f"lsn = {i}").withColumn("lsn", more["lsn"] + 100))
    s.manifest.commit(add=[(3, 99)])  # an older tier: its keys may still be hidden by the tombstone
    spark.createDataFrame([("k1", 1, False, "old")], SCHEMA).write.parquet(s.run_path(3, 99))
    s.compact()
    assert "k1" not in live(m.materialize(s.read()))
    assert s.bytes_on_disk() > 0


def test_a_batch_makes_one_run(spark, tmp_path):
    s = RunStore(spark, f"{tmp_path}/s")
    d = log(spark, ("a", "1"))
    assert [s.flush(d, batch="b1"), s.flush(d, batch="b1"), s.flush(d, batch="b2"), s.flush(d.where("false"))] == [1, -1, 2, -1]
    assert s.manifest.live() == [(0, 2), (0, 1)] == sorted(s.on_disk(), reverse=True)


def test_a_manifest_snapshot_says_what_its_files_said(spark, tmp_path):
    s = RunStore(spark, f"{tmp_path}/s")
    for i in range(3):
        s.flush(log(spark, (f"k{i}", "v")), batch=f"q#{i}")
    s.manifest.commit(drop=[(0, 3)])
    s.manifest.snapshot()
    s.manifest.snapshot()
    assert s.manifest.files() == ["000000000004.snap"]
    assert s.manifest.live() == [(0, 2), (0, 1)] and s.manifest.next_seq() == 4 and s.manifest.batches() == {"q#2"}
    assert s.flush(log(spark, ("k9", "v")), batch="q#3") == 4
    assert s.manifest.files() == ["000000000004.snap", "000000000005.log"] and s.manifest.live()[0] == (0, 4)


def test_recovery_replays_logs_in_order_and_removes_them(spark, tmp_path):
    from tidelog.sources import wal

    folder = f"file://{tmp_path}/logs"
    d = spark.createDataFrame([(2, 1, "a", False, "old"), (2, 2, "k5", False, "x"), (10, 1, "a", False, "new"), (10, 2, "k5", True, None)], "wal_seq long, lsn long, key string, tombstone boolean, value string")
    assert wal.write(d, folder) == ["wal-10.log", "wal-2.log"]
    at = tmp_path / "logs" / "wal-10.log"
    at.write_bytes(at.read_bytes() + wal.frame(wal.PUT, b"torn", b"value")[:-3])
    for p in (tmp_path / "logs").glob(".*.crc"):
        p.unlink()
    s = RunStore(spark, f"{tmp_path}/s")
    assert s.recover(folder) == 1
    assert live(m.materialize(s.read())) == {"a": "new"}
    assert not list((tmp_path / "logs").glob("wal-*")) and s.recover(folder) == -1


def test_pick_tier_and_may_drop(spark):
    runs = spark.createDataFrame([(0, i) for i in range(3)] + [(1, i) for i in range(5)], "gen int, seq long")
    assert pick_tier(runs).first()["gen"] == 1
    assert pick_tier(runs.where("gen = 0")).first()["gen"] is None
    assert may_drop(runs, 1) and not may_drop(runs, 0)


def test_manifest_fails_on_a_torn_line_unless_it_is_the_last(spark, tmp_path):
    s = RunStore(spark, f"{tmp_path}/s")
    s.flush(log(spark, ("a", "1")))
    at = tmp_path / "s" / "manifest"
    first = next(at.glob("*.log"))
    for p in at.glob(".*.crc"):
        p.unlink()
    first.write_text("ADD 0 1\nADD 0")
    assert s.manifest.live() == [(0, 1)]
    first.write_text("ADD 0\nADD 0 1\n")
    with pytest.raises(ValueError):
        s.manifest.live()


def test_blocks(spark):
    d = spark.createDataFrame([(1, f"k{i:03d}") for i in range(10)], "run int, key string")
    ix = block_ranges(d, 4)
    assert [(r["block"], r["first_key"], r["start"], r["end"]) for r in ix.orderBy("block").collect()] == [(0, "k000", 0, 4), (1, "k004", 4, 8), (2, "k008", 8, 10)]
    assert floor_block(ix, "k005").first()["block"] == 1
    assert floor_block(ix, "a").count() == 0


def test_any_split_and_merge_order_gives_the_replayed_table(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows, want = [], {}
        for lsn in range(60):
            k = f"k{rng.randrange(9)}"
            v = None if rng.random() < 0.3 else f"v{lsn}"
            rows.append((k, lsn, v is None, v, rng.randrange(5)))
            want.pop(k, None) if v is None else want.__setitem__(k, v)
        d = spark.createDataFrame(rows, SCHEMA + ", run int")
        parts = [d.where(f"run = {i}").drop("run") for i in rng.sample(range(5), 5)]
        first = merge(parts[0].union(parts[1]))
        assert live(m.merge_snapshots([parts[3], first, parts[4], parts[2]])) == want
