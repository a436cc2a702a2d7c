"""File formats: round trips, damage and torn tails."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.functions import varint
from tidelog.sources import sst, wal


@given(st.integers(0, 2**64 - 1))
def test_varint(n):
    assert varint.get(varint.put(n) + b"x", 0) == (n, len(varint.put(n)))


def test_varint_bounds():
    with pytest.raises(varint.Truncated):
        varint.get(b"\x80", 0)
    with pytest.raises(ValueError):
        varint.get(b"\xff" * 10, 0)
    with pytest.raises(varint.Truncated):
        varint.get_bytes(varint.put(2**60) + b"abc", 0)


RECORDS = [(wal.PUT, b"k1", b"v1"), (wal.PUT, b"k2", b"v2"), (wal.DELETE, b"k1", None), (wal.PUT, b"", b"")]


def test_wal_replays_in_order_and_stops_at_damage():
    data = b"".join(wal.frame(*r) for r in RECORDS)
    assert list(wal.replay(data)) == RECORDS
    assert list(wal.replay(data[:-3])) == RECORDS[:3]
    torn = wal.frame(wal.PUT, b"good", b"value") + wal.frame(wal.PUT, b"torn", b"x" * 20)
    assert list(wal.replay(torn[:-5])) == [(wal.PUT, b"good", b"value")]
    bad = bytearray(data)
    bad[len(wal.frame(*RECORDS[0])) + 6] ^= 0xFF
    assert list(wal.replay(bytes(bad))) == RECORDS[:1]
    assert list(wal.replay(b"")) == []


@settings(max_examples=60)
@given(st.lists(st.tuples(st.binary(max_size=9), st.binary(max_size=9)), max_size=8), st.integers(0, 200))
def test_a_cut_log_gives_a_prefix(rows, cut):
    want = [(wal.PUT, k, v) for k, v in rows]
    got = list(wal.replay(b"".join(wal.frame(*r) for r in want)[:cut]))
    assert got == want[: len(got)]


def test_wal_tables(spark, tmp_path):
    (tmp_path / "wal-2.log").write_bytes(b"".join(wal.frame(*r) for r in RECORDS))
    (tmp_path / "wal-10.log").write_bytes(wal.frame(wal.PUT, b"z", b"1")[:-1])
    (tmp_path / "other.txt").write_bytes(b"x")
    want = [(2, i, *r) for i, r in enumerate(RECORDS)]
    rows = sorted((r[0], r[1], r[2], bytes(r[3]), None if r[4] is None else bytes(r[4])) for r in wal.read(spark, str(tmp_path)).collect())
    assert rows == want
    spark.dataSource.register(wal.WalSource)
    rows = sorted((r[0], r[1], r[2], bytes(r[3]), None if r[4] is None else bytes(r[4])) for r in spark.read.format("tidelog_wal").load(str(tmp_path)).collect())
    assert rows == want


def entries(n):
    return [(f"key-{i:04d}".encode(), i % 7 == 3, None if i % 7 == 3 else f"value-{i}".encode()) for i in range(n)]


def test_run_round_trip_and_lookup():
    run = sst.Run(sst.encode(entries(500), 64))
    assert len(run.offsets) >= 2
    assert [(k, t, v) for _, k, t, v in run.scan()] == entries(500)
    for k, t, v in entries(500):
        assert run.get(k) == (v, t, True)
    assert run.get(b"not-a-key") == (None, False, False) == run.get(b"a")
    assert list(sst.Run(sst.encode([])).scan()) == []


def test_run_damage_is_an_error():
    with pytest.raises(ValueError):
        sst.encode([(b"b", False, b""), (b"a", False, b"")])
    data = bytearray(sst.encode([(b"a", False, b"1"), (b"b", False, b"2")]))
    data[6] = 0xFF
    with pytest.raises(sst.CorruptRun):
        sst.Run(bytes(data)).get(b"a")
    for bad in (b"", bytes(data[:-1]), bytes(data[:-1]) + b"\0"):
        with pytest.raises(sst.CorruptRun):
            sst.Run(bad)


def test_run_tables(spark, tmp_path):
    (tmp_path / "sst-1-7.sst").write_bytes(sst.encode(entries(40), 64))
    d = sst.read(spark, str(tmp_path))
    rows = sorted((bytes(r["key"]), r["tombstone"], None if r["value"] is None else bytes(r["value"])) for r in d.collect())
    assert rows == entries(40)
    assert d.select("gen", "seq").distinct().collect() == [(1, 7)]


def test_logs_are_written_and_read_as_a_data_source(spark, tmp_path):
    spark.dataSource.register(wal.WalSource)
    d = spark.createDataFrame([(n, i, 1 + (i == 2), f"k{i}".encode(), None if i == 2 else b"v") for n in (1, 2, 3) for i in range(4)], wal.SCHEMA)
    d.repartition("wal_seq").sortWithinPartitions("wal_seq", "record_no").write.format("tidelog_wal").mode("append").save(f"{tmp_path}/logs")
    assert sorted(p.name for p in (tmp_path / "logs").iterdir()) == ["wal-1.log", "wal-2.log", "wal-3.log"]
    key = lambda r: (r["wal_seq"], r["record_no"], r["type"], bytes(r["key"]), r["value"] and bytes(r["value"]))
    assert sorted(map(key, spark.read.format("tidelog_wal").load(f"{tmp_path}/logs").collect())) == sorted(map(key, d.collect()))
    with pytest.raises(Exception, match="several tasks"):
        d.repartition(5, "record_no").write.format("tidelog_wal").mode("append").save(f"{tmp_path}/more")
    assert not list((tmp_path / "more").iterdir())
