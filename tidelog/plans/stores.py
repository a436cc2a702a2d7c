"""Queries that write files, stores and streams in the shared folder and read them back, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import manifest, metrics, mutations, raftlog, runs
from tidelog.operators.runs import RunStore
from tidelog.plans.catalogue import _LOG, _TOP, AS_OF, _state, log
from tidelog.session import scratch, ship, table
from tidelog.sources import sst, wal
from tidelog.streaming import monitor, state

PARTS = 8  # flushes and files of a stream


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with `part`: eighths of the range of lsns."""
    d = log(spark, sf_dir)
    end = d.agg((F.max("lsn") + 1).alias("_end"))
    return d.join(F.broadcast(end)).withColumn("part", F.expr(f"lsn * {PARTS} div _end")).drop("_end")  # one row


def _wal(spark: SparkSession, sf_dir: str, name: str) -> str:
    ship(spark)
    folder = scratch(spark, name)
    wal.write(log(spark, sf_dir).withColumnRenamed("run", "wal_seq"), folder)
    return folder


def wal_replay(spark, sf_dir):
    """The log written as files and replayed: every record in its place."""
    return wal.read(spark, _wal(spark, sf_dir, "wal")).select("wal_seq", "record_no", (F.col("type") == wal.DELETE).alias("tombstone"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("double").alias("value"))


def wal_recovery(spark, sf_dir):
    """Logs on disk, replayed into a tier-0 run and removed; the live rows of the store, with the run that holds them."""
    folder = _wal(spark, sf_dir, "wal")
    store = RunStore(spark, scratch(spark, "store"), value_type="double")
    store.recover(folder)
    left = wal.read(spark, folder).agg(F.count(F.lit(1)).alias("log_records_left"))
    return runs.merge(store.read(runs=True), drop_tombstones=True).select("key", "value", "gen", "seq").join(F.broadcast(left))  # one row


def store_with_logs(spark, sf_dir):
    """Live rows of a store whose older logs were flushed and whose newer ones are only logged: runs and logs read together."""
    ship(spark)
    d, folder = _part(spark, sf_dir).withColumnRenamed("part", "wal_seq"), scratch(spark, "wal")
    store = RunStore(spark, scratch(spark, "store"), value_type="double")
    wal.write(d.where(F.col("wal_seq") < PARTS // 2), folder)
    store.recover(folder)
    wal.write(d.where(F.col("wal_seq") >= PARTS // 2), folder)
    both = mutations.merge_snapshots([store.read(), wal.mutations(wal.read(spark, folder), "double")])
    return both.select("key", "value", (F.expr("lsn div 4294967296")).alias("log"))


def _sst(spark: SparkSession, sf_dir: str) -> str:
    ship(spark)
    folder = scratch(spark, "sst")
    sst.write(mutations.latest(log(spark, sf_dir), "run").withColumnRenamed("run", "seq"), folder)
    return folder


def sst_scan(spark, sf_dir):
    """Each run flushed to a sorted file, and all files scanned."""
    return sst.read(spark, _sst(spark, sf_dir)).select("gen", "seq", F.col("key").cast("string").alias("key"), "tombstone", F.col("value").cast("string").cast("double").alias("value"))


def sst_get(spark, sf_dir):
    """What each run file says of one key."""
    return sst.get(spark, _sst(spark, sf_dir), b"42").select("gen", "seq", "found", "tombstone", F.col("value").cast("string").cast("double").alias("value"))


def _store(spark: SparkSession, sf_dir: str) -> RunStore:
    store = RunStore(spark, scratch(spark, "store"), value_type="double")
    d = _part(spark, sf_dir)
    for n in range(PARTS):
        store.flush(d.where(F.col("part") == n))
        store.compact()
    return store


def store_cascade(spark, sf_dir):
    """A store after eight flushes with compaction after each: every mutation that is left, with its run."""
    return _store(spark, sf_dir).read(runs=True)


def store_manifest(spark, sf_dir):
    """The store's live runs after the same, in the order that readers ask them."""
    store = _store(spark, sf_dir)
    store.manifest.snapshot()
    store.clean(0)
    on_disk = set(store.on_disk())
    return spark.createDataFrame([(g, s, place, (g, s) in on_disk) for place, (g, s) in enumerate(store.manifest.live(), 1)], "gen int, seq long, place int, on_disk boolean")


def _files(spark: SparkSession, sf_dir: str, order, twice: bool = False) -> DataFrame:
    """events as a stream of PARTS files, one a batch, in the given order."""
    e = table(spark, sf_dir, "events")
    path = scratch(spark, "stream-files")
    e = e.union(e) if twice else e
    e.repartitionByRange(PARTS, order).sortWithinPartitions(order).write.parquet(path)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((s.getPath() for s in fs.globStatus(Path(f"{path}/part-*"))), key=lambda p: p.getName())
    for k, f in enumerate(files):  # a stream takes files by their times; those of one job are all alike
        fs.setTimes(f, 1_000_000_000_000 + 1000 * k, -1)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _mutations(e: DataFrame) -> DataFrame:
    return mutations.mutation_view(e, F.col("user_id").cast("string"), F.col("event_id"), F.col("event_type") == "error", F.col("value"))


def _settled(spark: SparkSession, stream: DataFrame, mode: str = "update") -> DataFrame:
    """All that a stream wrote until its input ended, by batch."""
    path = scratch(spark, "stream")
    state.to_folder(stream, f"{path}/out", f"{path}/checkpoint", mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_lww(spark, sf_dir):
    """The state of all keys after a stream of events in order."""
    return mutations.latest(_settled(spark, state.lww_stream(_mutations(_files(spark, sf_dir, F.col("event_id"))))).drop("batch"))


def stream_out_of_order(spark, sf_dir):
    """The same after a stream of events in random order, each twice."""
    shuffled = _files(spark, sf_dir, F.md5(F.col("event_id").cast("string")), twice=True)
    return mutations.latest(_settled(spark, state.lww_stream(_mutations(shuffled))).drop("batch"))


def stream_flush(spark, sf_dir):
    """A stream whose batches become runs with compaction: the live rows of the store."""
    at = scratch(spark, "stream-store")
    store = RunStore(spark, f"{at}/store", value_type="double")
    state.flush_batches(_mutations(_files(spark, sf_dir, F.col("event_id"))), store, f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return runs.merge(store.read(), drop_tombstones=True).select("key", "lsn", "value")


def stream_retries(spark, sf_dir):
    """Requests of a stream that sends each twice, counted once, by hour."""
    e = _files(spark, sf_dir, F.col("ts"), twice=True).select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    d = _settled(spark, state.without_retries(e), "append")
    return d.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("requests"))


def stream_windows(spark, sf_dir):
    """Requests by hour, op and result of a stream: the last count that it told of each window."""
    e = _files(spark, sf_dir, F.col("ts"))
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.when(F.col("value") > 200, "error").otherwise("ok").alias("result"))
    d = _settled(spark, state.windowed_totals(e))
    return d.groupBy(F.col("window.start").alias("window_start"), "op", "result").agg(F.max_by("requests", "batch").alias("requests"))


def stream_progress(spark, sf_dir):
    """What a stream told of itself: batches with rows, and their rows."""
    path = scratch(spark, "stream")
    q = state.to_folder(_files(spark, sf_dir, F.col("event_id")), f"{path}/out", f"{path}/checkpoint", "append").trigger(availableNow=True).start()
    q.awaitTermination()
    return monitor.progress(spark, q).where("input_rows > 0").agg(F.count(F.lit(1)).alias("batches"), F.sum("input_rows").alias("input_rows"))


def manifest_text(spark, sf_dir):
    """Manifest lines by customer, read up to the first bad one of each; what is live after that."""
    o = table(spark, sf_dir, "orders")
    verb = F.when(F.col("o_orderstatus") == "F", "DEL").when(F.col("o_totalprice") > 400000, "NOTE").otherwise("ADD")
    line = F.when(F.col("o_totalprice") < 2000, "ADD 0").otherwise(F.concat_ws(" ", verb, F.lit("0"), F.col("o_orderkey").cast("string")))
    return manifest.live_set(manifest.parse_log(o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("pos"), line.alias("line"))), "file", "gen", "seq")


def state_snapshot(spark, sf_dir):
    """Servers' terms, votes and logs made durable twice, the second time with shorter logs, and read back."""
    e = table(spark, sf_dir, "events")
    logs = e.select((F.col("user_id") % 5).cast("int").alias("server"), F.col("event_id").alias("idx"), F.floor(F.col("event_id") / 700).alias("term"), F.col("event_type").alias("command"))
    states = logs.groupBy("server").agg(F.max("term").alias("term"), (F.col("server") % 3).cast("int").alias("voted_for"), F.lit(AS_OF).cast("long").alias("last_included"))
    store = RunStore(spark, scratch(spark, "state"))
    raftlog.save_state(states, logs, store)
    raftlog.save_state(states, logs.where(F.col("idx") > AS_OF), store)
    s, l = raftlog.load_state(store)
    return l.join(s.withColumnRenamed("term", "current_term"), "server")


def live_keys_over_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.select("ts", F.col("user_id").alias("key"), F.col("event_id").alias("lsn"), (F.col("event_type") == "error").alias("tombstone"))
    return metrics.live_keys_over_time(d)


def key_count_gauge(spark, sf_dir):
    """The gauge over the log, and over a log that is not there."""
    good = metrics.gauge(lambda: mutations.key_count(_state(log(spark, sf_dir))).first()[0])
    bad = metrics.gauge(lambda: spark.read.parquet(scratch(spark, "missing")).count())
    return spark.createDataFrame([(good, bad)], "live_keys long, unreadable long")


def workload(spark, sf_dir):
    """A load of as many operations as there are events: operations and distinct keys by op."""
    d = metrics.workload(table(spark, sf_dir, "events").select(F.col("event_id").alias("op_no")))
    return d.groupBy("op").agg(F.count(F.lit(1)).alias("ops"), F.countDistinct("key").alias("keys"))


def unreliable_network(spark, sf_dir):
    return metrics.unreliable(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 10).alias("sent_ms")))


def runs_out_of_order(spark, sf_dir):
    """Records of each run, in arrival order, whose key does not ascend: what a sorted run's writer refuses."""
    d = log(spark, sf_dir).select("run", "lsn", "key")
    return runs.order_violations(d, "run", "lsn")


def newest_runs_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.ascii(F.substring("o_orderpriority", 1, 1)).alias("gen"), F.col("o_orderkey").alias("seq"))
    return runs.newest_first(o.distinct())


def write_amp_on_disk(spark, sf_dir):
    """Rows put, and rows that eight flushes and their merges wrote, over the store's own runs."""
    d = _part(spark, sf_dir)
    put = d.agg(F.count(F.lit(1)).alias("put"))
    flushed = mutations.latest(d.select("part", "key", "lsn", "tombstone", "value"), "part")
    merged = runs.merge(d.where(f"part < {PARTS // 2}"), drop_tombstones=True).agg(F.count(F.lit(1)).alias("m1"))
    second = runs.merge(d.where(f"part >= {PARTS // 2}")).agg(F.count(F.lit(1)).alias("m2"))
    out = flushed.agg(F.count(F.lit(1)).alias("flushed")).join(F.broadcast(put)).join(F.broadcast(merged)).join(F.broadcast(second))  # one row each
    return out.select("put", "flushed", (F.col("m1") + F.col("m2")).alias("merged"), ((F.col("flushed") + F.col("m1") + F.col("m2") + F.col("put")) / F.col("put")).alias("amplification"))


_PART = f"{_LOG}, part AS (SELECT *, lsn * {PARTS} // (SELECT max(event_id) + 1 FROM events) AS part FROM log)"
_TOP_OF = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}key ORDER BY lsn DESC) AS r FROM {of}) WHERE r = 1)"
_LOW, _HIGH = (_TOP_OF.format(by="", of=f"(SELECT * FROM part WHERE part {x} {PARTS // 2})") for x in ("<", ">="))
_DRAW = "CAST('0x' || substr(md5('{what}:1:' || CAST({id} AS VARCHAR)), 1, 12) AS BIGINT)"
_draw = lambda what, of: _DRAW.format(what=what, id=of)

SQL = {
    "wal_replay": f"WITH {_LOG} SELECT run AS wal_seq, row_number() OVER (PARTITION BY run ORDER BY lsn) - 1 AS record_no, tombstone, key, CASE WHEN NOT tombstone THEN value END AS value FROM log",
    "wal_recovery": f"WITH {_LOG}, {_TOP} SELECT key, value, 0 AS gen, CAST(1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS log_records_left FROM top WHERE NOT tombstone",
    "store_with_logs": f"WITH {_PART} SELECT key, value, part AS log FROM {_TOP_OF.format(by='', of='part')} WHERE NOT tombstone",
    "sst_scan": f"WITH {_LOG} SELECT 0 AS gen, run AS seq, key, tombstone, CASE WHEN NOT tombstone THEN value END AS value FROM {_TOP_OF.format(by='run, ', of='log')}",
    "sst_get": f"WITH {_LOG}, r AS (SELECT DISTINCT run FROM log), hit AS (SELECT * FROM {_TOP_OF.format(by='run, ', of='log')} WHERE key = '42') SELECT 0 AS gen, r.run AS seq, hit.key IS NOT NULL AS found, coalesce(tombstone, false) AS tombstone, CASE WHEN NOT tombstone THEN value END AS value FROM r LEFT JOIN hit ON r.run = hit.run",
    "store_cascade": f"WITH {_PART} SELECT key, lsn, tombstone, value, 1 AS gen, CAST(5 AS BIGINT) AS seq FROM {_LOW} WHERE NOT tombstone UNION ALL SELECT key, lsn, tombstone, value, 1, 10 FROM {_HIGH}",
    "store_manifest": "SELECT 1 AS gen, CAST(seq AS BIGINT) AS seq, place, true AS on_disk FROM (VALUES (10, 1), (5, 2)) t(seq, place)",
    "stream_lww": f"WITH {_LOG}, {_TOP} SELECT key, lsn, tombstone, value FROM top",
    "stream_out_of_order": f"WITH {_LOG} SELECT key, max(lsn) AS lsn, arg_max(tombstone, lsn) AS tombstone, arg_max_null(value, lsn) AS value FROM log GROUP BY key",
    "stream_flush": f"WITH {_LOG} SELECT key, lsn, value FROM log l WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM log m WHERE m.key = l.key AND m.lsn > l.lsn)",
    "stream_retries": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS requests FROM events GROUP BY ALL",
    "stream_windows": "SELECT date_trunc('hour', ts) AS window_start, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CASE WHEN value > 200 THEN 'error' ELSE 'ok' END AS result, count(*) AS requests FROM events GROUP BY ALL",
    "stream_progress": f"SELECT CAST({PARTS} AS BIGINT) AS batches, count(*) AS input_rows FROM events",
    "manifest_text": "WITH o AS (SELECT o_custkey AS file, o_orderkey AS pos, o_totalprice < 2000 AS bad, CASE WHEN o_orderstatus = 'F' THEN 'DEL' WHEN o_totalprice > 400000 THEN 'NOTE' ELSE 'ADD' END AS op FROM orders), w AS (SELECT *, min(CASE WHEN bad THEN pos END) OVER (PARTITION BY file) AS cut FROM o) SELECT file, 0 AS gen, pos AS seq FROM w WHERE (cut IS NULL OR pos < cut) AND op = 'ADD'",
    "state_snapshot": f"WITH l AS (SELECT CAST(user_id % 5 AS INTEGER) AS server, event_id AS idx, CAST(floor(event_id / 700) AS BIGINT) AS term, event_type AS command FROM events), s AS (SELECT server, max(term) AS current_term, CAST(server % 3 AS INTEGER) AS voted_for, CAST({AS_OF} AS BIGINT) AS last_included FROM l GROUP BY server) SELECT server, idx, term, command, current_term, voted_for, last_included FROM l JOIN s USING (server) WHERE idx > {AS_OF}",
    "live_keys_over_time": "WITH c AS (SELECT ts, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END - coalesce(lag(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS c FROM events), h AS (SELECT date_trunc('hour', ts) AS window_start, sum(c) AS c FROM c GROUP BY 1) SELECT window_start, CAST(sum(c) OVER (ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live_keys FROM h",
    "key_count_gauge": f"WITH {_LOG}, {_TOP} SELECT count(*) AS live_keys, CAST(-1 AS BIGINT) AS unreadable FROM top WHERE NOT tombstone",
    "workload": f"SELECT CASE WHEN {_draw('op', 'event_id')} % 100 < 50 THEN 'put' ELSE 'get' END AS op, count(*) AS ops, count(DISTINCT {_draw('key', 'event_id')} % 10000) AS keys FROM events GROUP BY 1",
    "unreliable_network": f"WITH m AS (SELECT event_id AS id, event_id * 10 AS sent_ms, CASE WHEN {_draw('request', 'event_id')} % 1000 < 100 THEN 'request_lost' WHEN {_draw('reply', 'event_id')} % 1000 < 100 THEN 'reply_lost' ELSE 'delivered' END AS outcome FROM events) SELECT id, sent_ms, outcome, CASE WHEN outcome = 'delivered' THEN sent_ms + {_draw('delay', 'id')} % 27 + CASE WHEN {_draw('late', 'id')} % 900 < 600 THEN 200 + {_draw('by', 'id')} % 2000 ELSE 0 END END AS arrived_ms FROM m",
    "runs_out_of_order": f"WITH {_LOG} SELECT * FROM (SELECT run, lsn, key, lag(key) OVER (PARTITION BY run ORDER BY lsn) AS before FROM log) WHERE key <= before",
    "newest_runs_first": "SELECT gen, seq, CAST(row_number() OVER (PARTITION BY gen ORDER BY seq DESC) AS INTEGER) AS place FROM (SELECT DISTINCT ascii(o_orderpriority) AS gen, o_orderkey AS seq FROM orders)",
    "write_amp_on_disk": f"WITH {_PART}, f AS (SELECT count(*) AS flushed FROM (SELECT DISTINCT part, key FROM part)), m AS (SELECT (SELECT count(*) FROM {_LOW} WHERE NOT tombstone) + (SELECT count(*) FROM {_HIGH}) AS merged), p AS (SELECT count(*) AS put FROM log) SELECT put, flushed, merged, (flushed + merged + put) / CAST(put AS DOUBLE) AS amplification FROM f, m, p",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        wal_replay, wal_recovery, store_with_logs, sst_scan, sst_get, store_cascade, store_manifest, stream_lww, stream_out_of_order, stream_flush, stream_retries, stream_windows,
        stream_progress, manifest_text, state_snapshot, live_keys_over_time, key_count_gauge, workload, unreliable_network, runs_out_of_order, newest_runs_first, write_amp_on_disk,
    )
    return {f.__name__: f for f in found}
