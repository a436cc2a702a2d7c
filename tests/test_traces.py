"""Metrics, log traces, hashes, streams and the registered queries."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidelog.functions import hashing as h
from tidelog.operators import manifest, metrics, raftlog
from tidelog.operators import mutations as m
from tidelog.operators.runs import RunStore
from tidelog.plans import catalogue
from tidelog.streaming.state import flush_batches, lww_stream, windowed_totals, without_retries

from .conftest import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_nearest_rank(spark):
    d = spark.createDataFrame([("a", i) for i in range(1, 11)] + [("b", 5)], "g string, v int")
    assert rows(metrics.nearest_rank(d, ["g"], "v")) == [("a", 10, 6, 10, 10, 10), ("b", 1, 5, 5, 5, 5)]


def test_histogram_keeps_empty_buckets(spark):
    d = spark.createDataFrame([("get", 0.3), ("get", 7.0)], "op string, s double")
    got = {r["le"]: r["hits"] for r in metrics.latency_histogram(d, ["op"], "s", (0.1, 0.5)).collect()}
    assert got == {0.1: 0, 0.5: 1, float("inf"): 2}


def test_load_report_counts_failures(spark):
    d = spark.createDataFrame([(10, True, False), (21, False, True)], "latency_ns long, is_write boolean, error boolean")
    assert rows(metrics.load_report(d, 4)) == [(2, 1, 0.5, 15, 21, 1)]


def test_manifest_fold(spark):
    d = spark.createDataFrame([(1, "ADD", 0, 1), (2, "ADD", 0, 2), (3, "DEL", 0, 1), (4, "NOTE", 0, 2)], "pos long, op string, gen int, seq long")
    assert rows(manifest.live_set(d, "gen", "seq")) == [(0, 2)]
    t = spark.createDataFrame([(1, "ADD 0 1"), (2, "XXX 1 1"), (3, "ADD 0"), (4, "ADD 0 9")], "pos long, line string")
    assert rows(manifest.parse_log(t)) == [(1, "ADD", 0, 1)]


def test_commit_by_rank_and_by_count(spark):
    d = spark.createDataFrame([(1, p, x) for p, x in enumerate([5, 5, 3, 9, 1])] + [(2, 0, 4), (2, 1, 7)], "group_id int, peer int, match_index long")
    assert rows(raftlog.commit_index(d)) == rows(raftlog.commit_index_by_count(d)) == [(1, 5), (2, 4)]
    log = spark.createDataFrame([(1, 5, 2), (2, 4, 1)], "group_id int, idx long, term long")
    assert rows(raftlog.leader_commit(d, log, 2)) == [(1, 5)]


def test_votes(spark):
    q = "term int, candidate int, last_term int, last_index int, own_term int, voted_for int, own_last_term int, own_last_index int"
    d = spark.createDataFrame([(2, 1, 1, 5, 1, 9, 1, 5), (2, 1, 1, 5, 2, 9, 1, 5), (2, 1, 1, 4, 1, None, 1, 5), (1, 1, 9, 9, 2, None, 1, 1), (2, 1, 2, 1, 2, 1, 1, 9)], q)
    assert [r["granted"] for r in raftlog.grants(d).collect()] == [True, False, False, False, True]


def test_append_keeps_a_matching_suffix(spark):
    s = "server int, idx long, term long, command string"
    log = spark.createDataFrame([(1, i, 1, f"a{i}") for i in range(1, 6)], s)
    same = spark.createDataFrame([(1, 2, 1, "a2")], s)
    assert raftlog.after_append(log, same).count() == 5
    other = spark.createDataFrame([(1, 3, 2, "b3"), (1, 4, 2, "b4")], s)
    assert [r[3] for r in rows(raftlog.after_append(log, other))] == ["a1", "a2", "b3", "b4"]
    assert rows(raftlog.first_conflict(other.select("idx", "term"), log)) == [(1, 3)]


def test_append_check_and_backtracking(spark):
    log = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3)], "server int, idx long, term long")
    asks = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 2, 1), (3, 1, 9, 4), (4, 1, 4, 4)], "id int, server int, prev_idx long, prev_term long")
    got = {r["id"]: (r["ok"], r["conflict_term"], r["conflict_index"]) for r in raftlog.append_check(asks, log).collect()}
    assert got == {1: (True, None, None), 2: (True, None, None), 3: (False, None, 5), 4: (False, 3, 3)}
    leader = spark.createDataFrame([(1, 1), (2, 3), (3, 4)], "idx long, term long")
    back = raftlog.next_index(spark.createDataFrame([(1, 3, 3), (2, 9, 2), (3, None, 0)], "id int, conflict_term long, conflict_index long"), leader)
    assert rows(back) == [(1, 3), (2, 2), (3, 1)]


def test_snapshots(spark):
    log = spark.createDataFrame([(s, i, 1) for s in (1, 2, 3, 4) for i in (5, 6, 7)], "server int, idx long, term long")
    snaps = spark.createDataFrame([(1, 6, 1), (2, 6, 2), (3, 2, 1)], "server int, last_included long, included_term long")
    assert rows(raftlog.install_snapshot(log, snaps)) == [(1, 7, 1), *[(s, i, 1) for s in (3, 4) for i in (5, 6, 7)]]
    cuts = spark.createDataFrame([(1, 6, 7), (2, 7, 6), (3, 5, 9)], "server int, index long, last_applied long")  # one to do, one beyond what is applied, one at the base
    assert rows(raftlog.compact_log(log, cuts)) == [(1, 6, 1, True), (1, 7, 1, False), *[(s, i, 1, False) for s in (2, 3, 4) for i in (5, 6, 7)]]


def test_propose_and_apply(spark):
    log = spark.createDataFrame([(1, 4), (1, 5)], "group_id int, idx long")
    commands = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "group_id int, id int")
    assert sorted((r["id"], r["idx"]) for r in raftlog.propose(log, commands, "id").collect()) == [(10, 6), (11, 7), (12, 1)]
    assert [r["id"] for r in raftlog.applicable(spark.range(10).withColumn("idx", F.col("id")), F.lit(3), F.lit(5)).collect()] == [4, 5]


def test_acknowledged(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    p = spark.createDataFrame([(i, 1, i, 3, t(10)) for i in range(4)], "id int, server int, idx long, term long, ts timestamp")
    a = spark.createDataFrame([(1, 0, 3, t(12)), (1, 1, 4, t(11)), (1, 2, 3, t(13))], "server int, idx long, term long, ts timestamp")
    assert dict(rows(raftlog.acknowledged(p, a))) == {0: "ok", 1: "not_leader", 2: "error", 3: "error"}


def test_rounds_links_and_hints(spark):
    log = spark.createDataFrame([(i, i // 3) for i in range(5, 11)], "idx long, term long")
    p = spark.createDataFrame([("new", 1), ("behind", 3), ("near", 9), ("done", 11)], "peer string, next_index long")
    assert {r[0]: tuple(r[1:]) for r in rows(raftlog.append_requests(log, p))} == {"new": (0, 0, 10, False), "behind": (2, None, 8, True), "near": (8, 2, 2, False), "done": (10, 3, 0, False)}
    t = spark.createDataFrame([(1, 2, 1, True), (1, 3, 1, True), (3, 1, 2, False), (2, 3, 1, False)], "a int, b int, at int, up boolean")
    assert rows(raftlog.connected(t, 3)) == [(1, 1, True), (2, 1, True), (3, 0, False)]
    hints = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (4, 5), (5, 4), (6, None)], "server int, hint int")
    asks = spark.createDataFrame([(i, i) for i in range(1, 8)], "id int, server int")
    assert {r[0]: tuple(r[1:]) for r in rows(raftlog.follow_hints(asks, hints))} == {1: (3, 2), 2: (3, 1), 3: (3, 0), 4: (None, 8), 5: (None, 8), 6: (6, 0), 7: (7, 0)}
    assert all(v >= 0 for v in metrics.process_io().values())


def test_gauge_network_and_workload(spark):
    assert metrics.gauge(lambda: 3) == 3 and metrics.gauge(lambda: 1 / 0) == -1
    ids = spark.range(4000)
    w = metrics.workload(ids.select(F.col("id").alias("op_no")), keys=10, put_percent=25).groupBy("op").count()
    assert abs(dict(rows(w))["put"] - 1000) < 120
    n = dict(rows(metrics.unreliable(ids.select("id", F.lit(0).alias("sent_ms"))).groupBy("outcome").count()))
    assert abs(n["request_lost"] - 400) < 90 and abs(n["reply_lost"] - 360) < 90


def test_numbers_and_quotes(spark):
    from tidelog.functions import varint

    ns = [0, 1, 127, 128, 300, 16383, 16384, (1 << 40) + 5, (1 << 63) - 1]
    d = spark.createDataFrame([(n,) for n in ns], "n long").select("n", h.uvarint(F.col("n")).alias("v"), h.be_bytes(F.col("n")).alias("b"))
    assert all(bytes(r["v"]) == varint.put(r["n"]) and bytes(r["b"]) == r["n"].to_bytes(8, "big") for r in d.collect())
    q = spark.createDataFrame([('a "b"\\ \t\n',)], "s string").select(h.quoted(F.col("s"))).first()[0]
    assert q == '"a \\"b\\"\\\\ \\t\\n"'


def test_follower_commit(spark):
    d = spark.createDataFrame([(3, 9, 4, 2), (3, 5, 9, 9), (3, 2, 9, 9)], "c long, l long, p long, n long")
    assert [r[0] for r in d.select(raftlog.follower_commit(*map(F.col, "clpn"))).collect()] == [6, 5, 3]


def test_audits(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (1, 2, "y"), (2, 2, "z")], "server int, idx long, command string")
    assert rows(raftlog.safety_violations(a)) == [(2, 2)]
    assert rows(raftlog.commit_counts(a)) == [(1, 2, 1), (2, 2, 2)]
    c = spark.createDataFrame([(1, 1), (2, 1), (2, 3), (3, 7)], "term int, server int")
    assert rows(raftlog.election_violations(c)) == [(2, 2)]
    assert rows(raftlog.current_leader(c)) == [(7, False)] and rows(raftlog.current_leader(c.where("false"))) == [(None, True)]
    g = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 2, 4, 5])], "server int, arrival long, idx long")
    assert [r["idx"] for r in raftlog.apply_gaps(g).collect()] == [4]
    f = spark.createDataFrame([(1, i, x) for i, x in enumerate([3, 2, 3, 4])], "peer int, arrival long, seq long")
    assert [r[2] for r in rows(raftlog.fresh_replies(f))] == [3, 4]


def test_times(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    asks = spark.createDataFrame([(1, t(5)), (2, t(1)), (3, t(9))], "id int, ts timestamp")
    changes = spark.createDataFrame([(t(2), "a"), (t(9), "b")], "ts timestamp, leader string")
    assert {r["id"]: r["leader"] for r in raftlog.leader_at(asks, changes, 4).collect()} == {1: "a", 2: None, 3: "b"}
    beats = spark.createDataFrame([(1, t(0)), (1, t(1)), (1, t(8))], "server int, ts timestamp")
    assert sorted(r["beats"] for r in raftlog.silent_gaps(beats, "3 seconds").collect()) == [1, 2]


def test_hashes(spark):
    def fnv(b):
        x = h.FNV_BASIS
        for c in b:
            x = (x ^ c) * h.FNV_PRIME % 2**64
        return x

    d = spark.createDataFrame([("",), ("a",), ("key-é😀",), (None,)], "k string")
    for r in d.select("k", h.fnv1a64(F.col("k")).alias("h"), h.shard_id(F.col("k")).alias("s")).collect():
        assert (r["h"], r["s"]) == ((None, None) if r["k"] is None else (fnv(r["k"].encode()), fnv(r["k"].encode()) % 128))
    b = spark.createDataFrame([(bytearray(b"\x00\x00\x01\x02\xff\xff\xff\xff\xff\xff\xff\xff"),)], "b binary").select(h.be_u32(F.col("b"), 0), h.be_u64(F.col("b"), 4))
    assert tuple(b.first()) == (258, 2**64 - 1)
    n = spark.createDataFrame([("sst-2-13.sst",), ("wal-1.log",)], "n string").select(h.parse_run_name(F.col("n")).alias("p"))
    assert [r["p"] for r in n.collect()] == [(2, 13), None]
    assert spark.range(1).select(h.run_name(F.lit(2), F.lit(13)), h.log_name(F.lit(4)), h.tokens(F.lit(" put  a b "))).first() == ("sst-2-13.sst", "wal-4.log", ["put", "a", "b"])


@pytest.fixture()
def stream_folder(spark, tmp_path):
    """A mutation log in shuffled, repeated files."""
    d = catalogue.log(spark, SF).select("key", "lsn", "tombstone", "value")
    for i, part in enumerate((d.where("lsn % 3 = 2"), d.where("lsn % 3 = 0"), d.where("lsn % 2 = 0"), d.where("lsn % 3 = 1"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    return d, tmp_path


def test_stream_state_is_the_batch_answer(spark, stream_folder):
    d, at = stream_folder
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    q = lww_stream(s).writeStream.outputMode("update").format("memory").queryName("lww_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(m.latest(spark.table("lww_test"))) == rows(m.latest(d))


def test_stream_flushes_and_compacts(spark, stream_folder):
    d, at = stream_folder
    store = RunStore(spark, f"{at}/store", value_type="double", fanout=2)
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    q = flush_batches(s, store, f"{at}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(m.materialize(store.read())) == rows(m.materialize(d))
    assert len(store.manifest.live()) == 1


def test_stream_windows_and_retries(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([(t, "r1", "get", "ok"), (t, "r1", "get", "ok"), (t, "r2", "put", "ok")], "ts timestamp, request_id string, op string, result string")
    d.write.parquet(f"{tmp_path}/r")
    s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/r")
    q = without_retries(s).writeStream.format("memory").queryName("retries").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("retries").count() == 2
    q = windowed_totals(s).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["op"], r["requests"]) for r in spark.table("totals").collect()) == [("get", 2), ("put", 1)]


def test_stream_metrics_and_errors(spark, tmp_path):
    from tidelog.streaming.monitor import Latch, StreamMetrics, progress

    spark.range(10).write.parquet(f"{tmp_path}/in")
    seen = StreamMetrics()
    spark.streams.addListener(seen)
    s = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    good = s.writeStream.format("noop").trigger(availableNow=True).start()
    good.awaitTermination()

    def fail(*_):
        raise ValueError("no")

    bad = s.writeStream.foreachBatch(fail).trigger(availableNow=True).start()
    latch = Latch([good])
    latch.add(bad)
    with pytest.raises(Exception, match="no"):
        bad.awaitTermination()
    assert sum(r["input_rows"] for r in progress(spark, good).collect()) == 10
    first = latch.error()
    assert first is not None and latch.error() is first
    with pytest.raises(type(first)):
        latch.close()
    for _ in range(100):
        if seen.errors and seen.totals.get(str(good.id), {}).get("input_rows"):
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert seen.totals[str(good.id)]["input_rows"] == 10 and f'stream_input_rows{{query="{good.id}"}} 10' in seen.text()


def test_nearest_rank_of_one_value_nulls_and_many(spark):
    import random

    rng = random.Random(2)
    data = [("a", rng.gauss(0, 5)) for _ in range(3000)] + [("b", 1.5)] * 7 + [(None, 2.0), ("c", None)]
    d = spark.createDataFrame(data, "g string, v double")
    want = []
    for g in ("a", "b", None):
        v = sorted(x for k, x in data if k == g and x is not None)
        want.append((g, len(v), *(v[min(int(p * len(v)), len(v) - 1)] for p in (0.5, 0.9, 0.99)), v[-1]))
    assert rows(metrics.nearest_rank(d, ["g"], "v")) == sorted(want, key=repr)


def plain(v):
    """Numbers of both engines as floats, times as text."""
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, (bool, str)) or v is None else round(float(v), 9)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_queries_give_what_their_sql_gives(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("customer", "supplier", "orders", "lineitem", "events", "nation", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(catalogue.oracle_sql()[name])
    df = catalogue.queries()[name](spark, SF)
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect()) == sorted(str([plain(v) for v in r]) for r in got.fetchall())
