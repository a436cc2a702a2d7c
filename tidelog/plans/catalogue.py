"""Queries over the driver tables, each with the SQL it is held against.

The mutation log is made of events: key = user_id, lsn = event_id, a delete where the type is error.
Runs are thousands of lsns, tier-1 groups four runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import shard_id
from tidelog.operators import manifest, metrics, mutations, raftlog, runs
from tidelog.session import table

AS_OF = 5000


def _run() -> F.Column:
    return F.floor(F.col("event_id") / 1000).cast("long")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return mutations.mutation_view(e, F.col("user_id").cast("string"), F.col("event_id"), F.col("event_type") == "error", F.col("value"), _run().alias("run"))


def _state(log_: DataFrame, *cols: str) -> DataFrame:
    return log_.select("key", "lsn", "tombstone", "value", *cols)


def kv_materialize(spark, sf_dir):
    return mutations.materialize(_state(log(spark, sf_dir)))


def kv_point_get(spark, sf_dir):
    return mutations.get(_state(log(spark, sf_dir)), "42")


def kv_lookup(spark, sf_dir):
    return mutations.lookup(_state(log(spark, sf_dir)), "42")


def kv_multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return mutations.multi_get(_state(log(spark, sf_dir)), keys)


def kv_key_count(spark, sf_dir):
    return mutations.key_count(_state(log(spark, sf_dir)))


def kv_tombstones(spark, sf_dir):
    return mutations.tombstones(_state(log(spark, sf_dir)))


def kv_ordered_scan(spark, sf_dir):
    return mutations.placed(mutations.ordered_scan(_state(log(spark, sf_dir)), "1", "5"))


def kv_ordered_walk(spark, sf_dir):
    """All keys in byte order, deleted ones included."""
    return mutations.placed(mutations.latest(_state(log(spark, sf_dir))))


def kv_delete_keys(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("key"))
    return mutations.delete_keys(kv_materialize(spark, sf_dir), gone)


def kv_put_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    top = F.lit(1 << 40)
    changed = mutations.put(_state(log(spark, sf_dir)), c.where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("key"), (top + F.col("c_custkey")).alias("lsn"), F.col("c_acctbal").alias("value")))
    changed = mutations.delete(changed, c.where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("key"), (top + F.col("c_custkey")).alias("lsn")))
    return mutations.materialize(changed)


def kv_replayed_log(spark, sf_dir):
    """A log that was replayed whole: versions and newest lsn of each key, each mutation counted once."""
    d = _state(log(spark, sf_dir))
    return mutations.deduplicate(d.union(d)).groupBy("key").agg(F.count(F.lit(1)).alias("versions"), F.max("lsn").alias("lsn"))


def buffer_size(spark, sf_dir):
    return mutations.buffer_size(_state(log(spark, sf_dir)), F.when(F.col("value").isNotNull(), 8))


def wal_valid_prefix(spark, sf_dir):
    from tidelog.sources.wal import valid_prefix

    e = table(spark, sf_dir, "events").select(_run().alias("run"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("lsn"), (~F.col("props").like('%"k": 99}%')).alias("crc_ok"))
    return valid_prefix(e, "run", "lsn").drop("crc_ok")


def flush_runs(spark, sf_dir):
    return mutations.latest(log(spark, sf_dir), "run")


def compact_tier_keep(spark, sf_dir):
    d = log(spark, sf_dir).withColumn("tier_group", F.floor(F.col("run") / 4)).drop("run")
    return mutations.latest(d, "tier_group")


def compact_bottom_drop(spark, sf_dir):
    """Every four runs merged. Tombstones go from the oldest group only: in the others they may hide what older groups hold."""
    d = log(spark, sf_dir).withColumn("tier_group", F.floor(F.col("run") / 4)).drop("run")
    oldest = d.agg(F.min("tier_group").alias("oldest"))
    return mutations.latest(d, "tier_group").join(F.broadcast(oldest)).where("NOT (tombstone AND tier_group = oldest)").drop("oldest")  # one row


def _tiers(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(_run().alias("seq")).distinct()
    return r.select(F.when(F.col("seq") < 4, 1).otherwise(0).alias("gen"), "seq")


def tier_pick(spark, sf_dir):
    return runs.pick_tier(_tiers(spark, sf_dir))


def tier_runs(spark, sf_dir):
    return _tiers(spark, sf_dir).groupBy("gen").agg(F.count(F.lit(1)).alias("runs"), F.array_join(F.array_sort(F.collect_list("seq")).cast("array<string>"), ",").alias("seqs"))


def read_amplification(spark, sf_dir):
    return runs.read_amplification(log(spark, sf_dir))


def block_first_keys(spark, sf_dir):
    return runs.block_ranges(mutations.latest(log(spark, sf_dir), "run"), 32)


def block_floor(spark, sf_dir):
    return runs.floor_block(block_first_keys(spark, sf_dir), "42")


def as_of_lsn(spark, sf_dir):
    return mutations.as_of(_state(log(spark, sf_dir)), AS_OF)


def base_plus_tail(spark, sf_dir):
    """Live rows from a snapshot and the mutations after it, and which of the two each row is from."""
    d = _state(log(spark, sf_dir))
    return mutations.base_plus_tail(mutations.as_of(d, AS_OF), d, AS_OF).withColumn("from_tail", F.col("lsn") > AS_OF)


def manifest_live(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "F", "DEL").otherwise("ADD").alias("op"), F.col("o_custkey").alias("seq"))
    return manifest.live_set(o, "seq")


def orphan_runs(spark, sf_dir):
    disk = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"))
    live = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("seq"))
    return manifest.orphans(disk, live, "seq")


def replace_subset(spark, sf_dir):
    every = _tiers(spark, sf_dir).select(F.col("gen").cast("long").alias("gen"), "seq")
    old = every.where("gen = 1")
    new = old.agg(F.lit(2).cast("long").alias("gen"), (F.max("seq") + 1000).alias("seq"), F.count(F.lit(1)).alias("n")).where("n > 0").drop("n")
    return manifest.replace_subset(every, old, new, "gen", "seq")


def _requests(spark, sf_dir):
    op = F.when(F.col("event_type").isin("view", "click"), "get").when(F.col("event_type") == "error", "delete").otherwise("put")
    result = F.when(F.col("value") > 300, "error").when(F.col("value") > 200, "not_leader").otherwise("ok")
    return table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value", op.alias("op"), result.alias("result"))


def request_totals(spark, sf_dir):
    return metrics.request_totals(_requests(spark, sf_dir))


def latency_histogram(spark, sf_dir):
    """Whole units of a thousandth, so that the sums are exact; the last bucket is +Inf."""
    d = _requests(spark, sf_dir).select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("t"))
    return metrics.latency_histogram(d, ["event_type"], "t", (5e3, 1e4, 2.5e4, 5e4, 1e5, 2.5e5, 5e5))


def latency_nearest_rank(spark, sf_dir):
    return metrics.nearest_rank(_requests(spark, sf_dir), ["event_type"], "value")


def load_report(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.floor(F.col("value") * 1000).alias("latency_ns"), (F.col("event_type") != "view").alias("is_write"), (F.col("event_type") == "error").alias("error"))
    return metrics.load_report(d, 3600)


def write_amp(spark, sf_dir):
    d = log(spark, sf_dir).withColumn("tier_group", F.floor(F.col("run") / 4))
    return metrics.write_amplification(d, F.octet_length("key") + 8, (("run", "key"), ("tier_group", "key")))


def throughput_windows(spark, sf_dir):
    return metrics.throughput(_requests(spark, sf_dir))


def _progress(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("peer"), (F.col("s_suppkey") * 7 % 50).alias("match_index"))


def commit_index(spark, sf_dir):
    return raftlog.commit_index_by_count(_progress(spark, sf_dir))


def commit_index_by_rank(spark, sf_dir):
    return raftlog.commit_index(_progress(spark, sf_dir))


def leader_commit(spark, sf_dir):
    entries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("idx")).withColumn("term", F.floor(F.col("idx") / 10))
    return raftlog.leader_commit(_progress(spark, sf_dir), entries, 2)


def stale_reply_filter(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("arrival"), F.floor(F.col("value") * 100).cast("long").alias("seq"))
    return raftlog.fresh_replies(d)


def state_machine_safety(spark, sf_dir):
    return raftlog.safety_violations(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("command")))


def commit_counts(spark, sf_dir):
    return raftlog.commit_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("server"), F.col("l_partkey").alias("command")))


def _logs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    term = F.floor(F.col("event_id") / 700)
    leader = e.select(F.col("event_id").alias("idx"), term.alias("term"))
    server = (F.col("user_id") % 5).alias("server")
    follower = e.select(server, F.col("event_id").alias("idx"), F.when(F.col("event_id") > 4000 + F.col("user_id") % 5 * 500, term + 1).otherwise(term).alias("term"))
    return leader, follower


def log_first_conflict(spark, sf_dir):
    return raftlog.first_conflict(*_logs(spark, sf_dir))


def append_consistency(spark, sf_dir):
    _, follower = _logs(spark, sf_dir)
    appends = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("server"), (F.col("event_id") * 2).alias("prev_idx"), F.floor(F.col("event_id") * 2 / 700).alias("prev_term"))
    return raftlog.append_check(appends, follower)


def next_index(spark, sf_dir):
    """Where the leader goes back to after each refused append."""
    return raftlog.next_index(append_consistency(spark, sf_dir).where("NOT ok"), _logs(spark, sf_dir)[0])


def log_compaction(spark, sf_dir):
    """Five servers' copies of the log after snapshots, of which two go beyond what their servers have applied."""
    log_ = _logs(spark, sf_dir)[0].withColumn("server", F.explode(F.sequence(F.lit(0), F.lit(4))))
    n = F.col("id")
    return raftlog.compact_log(log_, spark.range(5).select(n.cast("int").alias("server"), (1500 + 2000 * n).alias("index"), (8000 - 1000 * n).alias("last_applied")))


def snapshot_install(spark, sf_dir):
    """Followers' logs after snapshots at their last entry below a bound; servers of odd numbers get one of another term."""
    follower = _logs(spark, sf_dir)[1]
    s = follower.where("idx <= 3000 + 600 * server").groupBy("server").agg(F.max_by(F.struct("idx", "term"), "idx").alias("l"))
    return raftlog.install_snapshot(follower, s.select("server", F.col("l.idx").alias("last_included"), (F.col("l.term") + F.col("server") % 2).alias("included_term")))


def propose(spark, sf_dir):
    """The index that each customer's command gets in its nation's log of suppliers."""
    log_ = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("idx"))
    commands = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("id"))
    return raftlog.propose(log_, commands, "id")


def vote_grants(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id")
    d = table(spark, sf_dir, "events").select(
        n.alias("id"), (n % 7).alias("term"), (u % 3).alias("candidate"), (n % 5).alias("last_term"), u.alias("last_index"), (u % 7).alias("own_term"),
        F.when(F.col("event_type") != "view", n % 3).alias("voted_for"), (u % 5).alias("own_last_term"), (n % 200).alias("own_last_index"),
    )
    return raftlog.grants(d).select("id", "granted")


def follower_commit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), raftlog.follower_commit(F.col("user_id"), F.floor("value").cast("long"), F.col("event_id") % 100, F.col("user_id") % 7).alias("commit"))


def applicable_entries(spark, sf_dir):
    """Entries that each server may apply next, up to its commit index."""
    follower = _logs(spark, sf_dir)[1]
    return raftlog.applicable(follower, F.col("server") * 500, F.col("server") * 500 + 3000)


def apply_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("server"), F.col("event_id").alias("arrival"), F.floor(F.col("event_id") / 5 + F.when(F.col("value") > 250, 1).otherwise(0)).cast("long").alias("idx"))
    return raftlog.apply_gaps(e)


def silent_gaps(spark, sf_dir):
    return raftlog.silent_gaps(table(spark, sf_dir, "events").select(F.col("user_id").alias("server"), "ts"), "1800500 milliseconds")


def acknowledged(spark, sf_dir):
    """What became of each proposal: the entry applied at its index may be of another term, late, or never come."""
    e = table(spark, sf_dir, "events")
    leader = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("server"), F.col("event_id").alias("idx"), F.floor(F.col("event_id") / 700).alias("term"), "ts")
    when = e.where("event_type <> 'view'").select(F.col("event_id").alias("idx"), (F.col("ts") + F.make_interval(secs=F.col("user_id") % 4)).alias("ts"))
    return raftlog.acknowledged(leader, _logs(spark, sf_dir)[1].join(when, "idx"))


def append_requests(spark, sf_dir):
    """A round of appends to suppliers as peers, from a log whose first hundred entries are compacted away."""
    leader = _logs(spark, sf_dir)[0].where("idx >= 100")
    return raftlog.append_requests(leader, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("peer"), (F.col("s_suppkey") * 7 % 900 + 1).alias("next_index")))


def connected(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("a"), (F.col("event_id") % 7).alias("b"), F.col("event_id").alias("at"), (F.col("value") < 60).alias("up"))
    return raftlog.connected(e, 7)


def follow_hints(spark, sf_dir):
    """Each customer asks the server of its nation, which names that of its region's number, until one names itself."""
    hints = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("server"), F.col("n_regionkey").alias("hint"))
    return raftlog.follow_hints(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("server")), hints)


def line_tokens(spark, sf_dir):
    """Words of each part's name, joined again and quoted."""
    from tidelog.functions.hashing import quoted, tokens

    p = table(spark, sf_dir, "part").select("p_partkey", tokens(F.concat_ws("  ", F.col("p_name"), F.col("p_type"))).alias("t"))
    return p.select("p_partkey", F.size("t").cast("long").alias("words"), quoted(F.array_join("t", '" ')).alias("line"))


def run_names(spark, sf_dir):
    """File names of runs and logs, and what they say when read."""
    from tidelog.functions.hashing import log_name, parse_run_name, run_name

    t = _tiers(spark, sf_dir).select(run_name(F.col("gen"), F.col("seq")).alias("name"), log_name(F.col("seq")).alias("log"), parse_run_name(run_name(F.col("gen"), F.col("seq"))).alias("p"))
    return t.select("name", "log", F.col("p.gen").cast("long").alias("gen"), "p.seq")


def numbers_as_bytes(spark, sf_dir):
    """Each order's key as base-128 and as big-endian bytes, and read back from the latter."""
    from tidelog.functions.hashing import be_bytes, be_u32, be_u64, uvarint

    n = F.col("o_orderkey") * 1000003
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.hex(uvarint(n)).alias("varint"), be_bytes(n).alias("b"))
    return d.select("o_orderkey", "varint", F.hex("b").alias("big_endian"), be_u32(F.col("b"), 4).alias("low"), be_u64(F.col("b"), 0).cast("long").alias("n"))


def log_suffix_replacement(spark, sf_dir):
    leader, follower = _logs(spark, sf_dir)
    own = follower.withColumn("command", F.col("idx"))
    incoming = follower.where("idx % 2 = 0").select("server", "idx").join(leader, "idx").select("server", "idx", "term", (F.col("idx") * 10).alias("command"))
    return raftlog.after_append(own, incoming)


def vote_up_to_date(spark, sf_dir):
    """Suppliers as peers of their nations: how many of the others would find each one's log new enough."""
    n = F.col("s_suppkey")
    return raftlog.possible_votes(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group_id"), n.alias("peer"), (n % 3).alias("last_term"), (n % 11).alias("last_index")))


def election_winners(spark, sf_dir):
    votes = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("term"), (F.col("user_id") % 2).alias("candidate"), (F.col("event_id") % 10).alias("voter"), (F.col("value") < 100).alias("granted"))
    return raftlog.election_winners(votes, 10)


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'signup' AND value > 150").select(F.floor(F.col("event_id") / 50).alias("term"), F.col("user_id").alias("server"))


def election_safety(spark, sf_dir):
    return raftlog.election_violations(_claims(spark, sf_dir))


def current_leader(spark, sf_dir):
    c = _claims(spark, sf_dir)
    return raftlog.current_leader(c.groupBy("term").agg(F.min("server").alias("server")))


def no_leader(spark, sf_dir):
    """The same of servers that claim nothing."""
    return raftlog.current_leader(_claims(spark, sf_dir).where("term < 0"))


def leader_hint(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asks = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("event_id").alias("ts"))
    changes = e.where("event_type = 'signup' AND value > 150").select(F.col("event_id").alias("ts"), F.col("user_id").alias("leader"))
    return raftlog.leader_at(asks, changes, 1000)


def shard_histogram(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key")).distinct()
    return keys.groupBy(shard_id(F.col("key")).alias("shard")).agg(F.count(F.lit(1)).alias("keys"))


def checksums(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.crc32("props").alias("crc"))


_LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS lsn, event_type = 'error' AS tombstone, CASE WHEN event_type <> 'error' THEN value END AS value, CAST(floor(event_id / 1000) AS BIGINT) AS run FROM events)"
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM log) WHERE r = 1)"
_TIERS = "tiers AS (SELECT DISTINCT CASE WHEN floor(event_id / 1000) < 4 THEN 1 ELSE 0 END AS gen, CAST(floor(event_id / 1000) AS BIGINT) AS seq FROM events)"
_BLOCKS = "blocks AS (SELECT run, CAST(floor(n / 32) AS BIGINT) AS block, min(key) AS first_key, count(*) AS rows, min(n) AS start FROM (SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY key) - 1 AS n FROM (SELECT DISTINCT run, key FROM log)) GROUP BY ALL)"
_REQUESTS = "requests AS (SELECT ts, event_type, value, CASE WHEN event_type IN ('view', 'click') THEN 'get' WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CASE WHEN value > 300 THEN 'error' WHEN value > 200 THEN 'not_leader' ELSE 'ok' END AS result FROM events)"
_LOGS = "leader AS (SELECT event_id AS idx, CAST(floor(event_id / 700) AS BIGINT) AS term FROM events), follower AS (SELECT user_id % 5 AS server, event_id AS idx, CAST(floor(event_id / 700) AS BIGINT) + CASE WHEN event_id > 4000 + user_id % 5 * 500 THEN 1 ELSE 0 END AS term FROM events)"
_APPENDS = "asks AS (SELECT event_id AS id, user_id % 5 AS server, event_id * 2 AS prev_idx, CAST(floor(event_id * 2 / 700) AS BIGINT) AS prev_term FROM events), ends AS (SELECT server, max(idx) AS last, min(idx) AS base FROM follower GROUP BY server), firsts AS (SELECT server, term, min(idx) AS first FROM follower GROUP BY server, term), j AS (SELECT a.*, f.term, e.last, e.base, m.first FROM asks a LEFT JOIN follower f ON f.server = a.server AND f.idx = a.prev_idx LEFT JOIN ends e ON e.server = a.server LEFT JOIN firsts m ON m.server = a.server AND m.term = f.term), k AS (SELECT *, prev_idx = 0 OR coalesce(term = prev_term, false) AS ok, prev_idx > coalesce(last, 0) AS past FROM j), checked AS (SELECT id, server, ok, CASE WHEN NOT ok AND NOT past THEN term END AS conflict_term, CASE WHEN ok THEN NULL WHEN past THEN coalesce(last, 0) + 1 ELSE coalesce(first, base) END AS conflict_index FROM k)"
_PROGRESS = "progress AS (SELECT s_nationkey AS group_id, s_suppkey AS peer, s_suppkey * 7 % 50 AS match_index FROM supplier)"
_QUORUM = "quorum AS (SELECT group_id, match_index AS commit_index FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY match_index DESC, peer) AS r, count(*) OVER (PARTITION BY group_id) AS n FROM progress) WHERE r = n // 2 + 1)"
_LIVE = f"WITH {_LOG}, {_TOP} SELECT key, lsn, value FROM top WHERE NOT tombstone"

SQL = {
    "kv_materialize": _LIVE,
    "kv_point_get": f"{_LIVE} AND key = '42'",
    "kv_lookup": f"WITH {_LOG}, {_TOP} SELECT count(*) > 0 AS found, coalesce(bool_or(tombstone), false) AS tombstone, max(value) AS value FROM top WHERE key = '42'",
    "kv_multi_get": f"WITH {_LOG}, {_TOP}, keys AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer) SELECT keys.key, top.key IS NOT NULL AS found, tombstone, value FROM keys LEFT JOIN top ON keys.key = top.key",
    "kv_key_count": f"WITH {_LOG}, {_TOP} SELECT count(*) AS live_keys FROM top WHERE NOT tombstone",
    "kv_tombstones": f"WITH {_LOG}, {_TOP} SELECT key, lsn FROM top WHERE tombstone",
    "kv_ordered_scan": f"WITH {_LOG}, {_TOP} SELECT key, lsn, value, row_number() OVER (ORDER BY key) AS place FROM top WHERE NOT tombstone AND key >= '1' AND key < '5'",
    "kv_delete_keys": f"{_LIVE} AND key NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')",
    "kv_put_delete": f"WITH {_LOG}, more AS (SELECT key, lsn, tombstone, value FROM log UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1099511627776 + c_custkey, c_acctbal < 0, CASE WHEN c_acctbal >= 0 THEN c_acctbal END FROM customer) SELECT key, lsn, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM more) WHERE r = 1 AND NOT tombstone",
    "kv_replayed_log": f"WITH {_LOG} SELECT key, count(*) AS versions, max(lsn) AS lsn FROM log GROUP BY key",
    "kv_ordered_walk": f"WITH {_LOG}, {_TOP} SELECT key, lsn, tombstone, value, row_number() OVER (ORDER BY key) AS place FROM top",
    "buffer_size": f"WITH {_LOG}, {_TOP} SELECT CAST(sum(octet_length(encode(key)) + CASE WHEN tombstone OR value IS NULL THEN 0 ELSE 8 END) AS BIGINT) AS bytes FROM top",
    "wal_valid_prefix": """WITH r AS (SELECT CAST(floor(event_id / 1000) AS BIGINT) AS run, CAST(user_id AS VARCHAR) AS key, event_id AS lsn, props LIKE '%"k": 99}%' AS bad FROM events), w AS (SELECT *, min(CASE WHEN bad THEN lsn END) OVER (PARTITION BY run) AS cut FROM r) SELECT run, key, lsn FROM w WHERE cut IS NULL OR lsn < cut""",
    "flush_runs": f"WITH {_LOG} SELECT key, lsn, tombstone, value, run FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY lsn DESC) AS r FROM log) WHERE r = 1",
    "compact_tier_keep": f"WITH {_LOG} SELECT key, lsn, tombstone, value, tier_group FROM (SELECT *, row_number() OVER (PARTITION BY tier_group, key ORDER BY lsn DESC) AS r FROM (SELECT *, CAST(floor(run / 4) AS BIGINT) AS tier_group FROM log)) WHERE r = 1",
    "compact_bottom_drop": f"WITH {_LOG} SELECT key, lsn, tombstone, value, tier_group FROM (SELECT *, row_number() OVER (PARTITION BY tier_group, key ORDER BY lsn DESC) AS r FROM (SELECT *, CAST(floor(run / 4) AS BIGINT) AS tier_group FROM log)) WHERE r = 1 AND NOT (tombstone AND tier_group = (SELECT CAST(floor(min(run) / 4) AS BIGINT) FROM log))",
    "tier_pick": f"WITH {_TIERS} SELECT min(gen) AS gen FROM (SELECT gen FROM tiers GROUP BY gen HAVING count(*) >= 4)",
    "tier_runs": f"WITH {_TIERS} SELECT gen, count(*) AS runs, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs FROM tiers GROUP BY gen",
    "read_amplification": f"WITH {_LOG} SELECT key, count(DISTINCT run) AS runs, count(*) AS versions FROM log GROUP BY key",
    "block_first_keys": f"WITH {_LOG}, {_BLOCKS} SELECT run, block, first_key, rows, start, coalesce(lead(start) OVER (PARTITION BY run ORDER BY block), start + rows) AS \"end\" FROM blocks",
    "block_floor": f"WITH {_LOG}, {_BLOCKS} SELECT run, max(block) AS block, max(first_key) AS first_key FROM blocks WHERE first_key <= '42' GROUP BY run",
    "as_of_lsn": f"WITH {_LOG} SELECT key, lsn, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM log WHERE lsn <= {AS_OF}) WHERE r = 1 AND NOT tombstone",
    "base_plus_tail": f"WITH {_LOG}, {_TOP} SELECT key, lsn, value, lsn > {AS_OF} AS from_tail FROM top WHERE NOT tombstone",
    "manifest_live": "SELECT seq FROM (SELECT o_custkey AS seq, max_by(CASE WHEN o_orderstatus = 'F' THEN 'DEL' ELSE 'ADD' END, o_orderkey) AS op FROM orders GROUP BY o_custkey) WHERE op = 'ADD'",
    "orphan_runs": "SELECT c_custkey AS seq FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "replace_subset": f"WITH {_TIERS} SELECT CAST(gen AS BIGINT) AS gen, seq FROM tiers WHERE gen <> 1 UNION ALL SELECT 2, max(seq) + 1000 FROM tiers WHERE gen = 1 HAVING count(*) > 0",
    "request_totals": f"WITH {_REQUESTS} SELECT op, result, count(*) AS requests FROM requests GROUP BY op, result",
    "latency_histogram": "SELECT event_type, CAST(le AS DOUBLE) AS le, count(*) FILTER (floor(value * 1000) <= CAST(le AS DOUBLE)) AS hits, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS sum FROM events, (VALUES ('5000'), ('10000'), ('25000'), ('50000'), ('100000'), ('250000'), ('500000'), ('inf')) b(le) GROUP BY event_type, le",
    "latency_nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, max(CASE WHEN k = least(floor(0.5 * n), n - 1) + 1 THEN value END) AS p50, max(CASE WHEN k = least(floor(0.9 * n), n - 1) + 1 THEN value END) AS p90, max(CASE WHEN k = least(floor(0.99 * n), n - 1) + 1 THEN value END) AS p99, max(value) AS max FROM r GROUP BY event_type",
    "load_report": "SELECT count(*) AS ops, count(*) FILTER (event_type = 'error') AS errors, count(*) / 3600.0::DOUBLE AS ops_per_s, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) // count(*) AS BIGINT) AS mean_ns, max(CAST(floor(value * 1000) AS BIGINT)) AS max_ns, count(*) FILTER (event_type <> 'view') AS writes FROM events",
    "write_amp": f"WITH {_LOG}, a AS (SELECT sum(length(key) + 8) AS x FROM log), b AS (SELECT sum(length(key) + 8) AS x FROM (SELECT DISTINCT run, key FROM log)), c AS (SELECT sum(length(key) + 8) AS x FROM (SELECT DISTINCT floor(run / 4), key FROM log)) SELECT CAST(a.x + b.x + c.x AS DOUBLE) / CAST(a.x AS DOUBLE) AS amplification FROM a, b, c",
    "throughput_windows": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS ops, count(*) / 3600.0::DOUBLE AS ops_per_s FROM events GROUP BY 1",
    "commit_index": f"WITH {_PROGRESS}, {_QUORUM} SELECT group_id, commit_index FROM quorum",
    "commit_index_by_rank": f"WITH {_PROGRESS} SELECT group_id, max(m) AS commit_index FROM (SELECT a.group_id, a.match_index AS m FROM progress a JOIN progress b ON a.group_id = b.group_id AND b.match_index >= a.match_index GROUP BY a.group_id, a.match_index HAVING count(DISTINCT b.peer) * 2 > (SELECT count(*) FROM progress c WHERE c.group_id = a.group_id)) GROUP BY group_id",
    "leader_commit": f"WITH {_PROGRESS}, {_QUORUM} SELECT group_id, commit_index FROM quorum WHERE commit_index // 10 = 2",
    "stale_reply_filter": "SELECT peer, arrival, seq FROM (SELECT *, max(seq) OVER (PARTITION BY peer ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT user_id AS peer, event_id AS arrival, CAST(floor(value * 100) AS BIGINT) AS seq FROM events)) WHERE top IS NULL OR seq > top",
    "state_machine_safety": "SELECT l_orderkey AS idx, count(DISTINCT l_partkey) AS commands FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1",
    "commit_counts": "SELECT l_orderkey AS idx, count(DISTINCT l_linenumber) AS servers, count(DISTINCT l_partkey) AS commands FROM lineitem GROUP BY 1",
    "log_first_conflict": f"WITH {_LOGS} SELECT server, min(idx) AS idx FROM follower JOIN leader USING (idx) WHERE follower.term <> leader.term GROUP BY server",
    "append_consistency": f"WITH {_LOGS}, {_APPENDS} SELECT id, server, ok, conflict_term, conflict_index FROM checked",
    "next_index": f"WITH {_LOGS}, {_APPENDS} SELECT id, greatest(coalesce(l.next, conflict_index), 1) AS next_index FROM checked LEFT JOIN (SELECT term, max(idx) + 1 AS next FROM leader GROUP BY term) l ON l.term = conflict_term WHERE NOT ok",
    "log_compaction": f"WITH {_LOGS}, s AS (SELECT CAST(server AS INTEGER) AS server, 1500 + 2000 * server AS cut, 8000 - 1000 * server AS applied FROM range(5) r(server)), d AS (SELECT s.server, idx, term, CASE WHEN cut > (SELECT min(idx) FROM leader) AND cut <= applied THEN cut END AS cut FROM leader, s) SELECT server, idx, term, coalesce(idx = cut, false) AS sentinel FROM d WHERE cut IS NULL OR idx >= cut",
    "snapshot_install": f"WITH {_LOGS}, s AS (SELECT server, max(idx) AS at, max_by(term, idx) + server % 2 AS included FROM follower WHERE idx <= 3000 + 600 * server GROUP BY server), m AS (SELECT s.server, s.at, f.term = s.included AS same FROM s JOIN follower f ON f.server = s.server AND f.idx = s.at) SELECT f.server, f.idx, f.term FROM follower f LEFT JOIN m ON m.server = f.server WHERE m.at IS NULL OR (m.same AND f.idx > m.at)",
    "propose": "SELECT c_nationkey AS group_id, c_custkey AS id, coalesce(last, 0) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS idx FROM customer LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS last FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey",
    "vote_grants": "SELECT event_id AS id, event_id % 7 >= user_id % 7 AND (event_id % 7 > user_id % 7 OR event_type = 'view' OR event_id % 3 = user_id % 3) AND (event_id % 5 > user_id % 5 OR (event_id % 5 = user_id % 5 AND user_id >= event_id % 200)) AS granted FROM events",
    "follower_commit": "SELECT event_id AS id, CASE WHEN floor(value) > user_id THEN greatest(user_id, least(CAST(floor(value) AS BIGINT), event_id % 100 + user_id % 7)) ELSE user_id END AS commit FROM events",
    "applicable_entries": f"WITH {_LOGS} SELECT server, idx, term FROM follower WHERE idx BETWEEN server * 500 + 1 AND server * 500 + 3000",
    "apply_gaps": "SELECT * FROM (SELECT server, arrival, idx, lag(idx) OVER (PARTITION BY server ORDER BY arrival) + 1 AS expected FROM (SELECT user_id % 5 AS server, event_id AS arrival, CAST(floor(event_id / 5 + CASE WHEN value > 250 THEN 1 ELSE 0 END) AS BIGINT) AS idx FROM events)) WHERE expected <> idx",
    "silent_gaps": "WITH s AS (SELECT user_id AS server, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1800500 MILLISECONDS THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY server ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT server, min(ts) AS start, max(ts) + INTERVAL 1800500 MILLISECONDS AS \"end\", count(*) AS beats FROM g GROUP BY server, n",
    "acknowledged": "SELECT event_id AS id, CASE WHEN event_type = 'view' OR user_id % 4 > 2 THEN 'error' WHEN event_id > 4000 + user_id % 5 * 500 THEN 'not_leader' ELSE 'ok' END AS outcome FROM events",
    "append_requests": f"WITH {_LOGS}, l AS (SELECT * FROM leader WHERE idx >= 100), p AS (SELECT s_suppkey AS peer, s_suppkey * 7 % 900 AS prev_idx FROM supplier) SELECT peer, prev_idx, CASE WHEN prev_idx = 0 THEN 0 ELSE term END AS prev_term, greatest((SELECT max(idx) FROM l) - prev_idx, 0) AS entries, prev_idx < (SELECT min(idx) FROM l) AND prev_idx > 0 AS snapshot FROM p LEFT JOIN l ON l.idx = p.prev_idx",
    "connected": "WITH t AS (SELECT user_id % 7 AS a, event_id % 7 AS b, event_id AS at_, value < 60 AS up FROM events), b AS (SELECT * FROM t UNION ALL SELECT b, a, at_, up FROM t), l AS (SELECT a AS server, b, max_by(up, at_) AS up FROM b WHERE a <> b GROUP BY a, b) SELECT server, count(*) FILTER (up) AS links, (count(*) FILTER (up) + 1) * 2 > 7 AS majority FROM l GROUP BY server",
    "follow_hints": "WITH RECURSIVE h AS (SELECT n_nationkey AS server, n_nationkey AS at_, 0 AS redirects FROM nation UNION ALL SELECT server, n_regionkey, redirects + 1 FROM h JOIN nation ON n_nationkey = at_ WHERE n_regionkey <> at_ AND redirects < 20), l AS (SELECT server, arg_max(at_, redirects) AS leader, max(redirects) AS redirects FROM h GROUP BY server) SELECT c_custkey AS id, CASE WHEN redirects < 9 THEN leader END AS leader, least(redirects, 8) AS redirects FROM customer JOIN l ON server = c_nationkey",
    "line_tokens": "SELECT p_partkey, CAST(len(t) AS BIGINT) AS words, '\"' || replace(array_to_string(t, '\" '), '\"', '\\\"') || '\"' AS line FROM (SELECT p_partkey, list_filter(regexp_split_to_array(p_name || '  ' || p_type, '\\s+'), lambda x: x <> '') AS t FROM part)",
    "run_names": f"WITH {_TIERS} SELECT 'sst-' || gen || '-' || seq || '.sst' AS name, 'wal-' || seq || '.log' AS log, CAST(gen AS BIGINT) AS gen, seq FROM tiers",
    "numbers_as_bytes": "WITH n AS (SELECT o_orderkey, o_orderkey * 1000003 AS n FROM orders), g AS (SELECT *, list_filter(range(10), lambda i: i = 0 OR n >= 128::HUGEINT ** i) AS places FROM n) SELECT o_orderkey, array_to_string(list_transform(places, lambda i: printf('%02X', CAST(n // CAST(128 ** i AS BIGINT) % 128 + CASE WHEN i < len(places) - 1 THEN 128 ELSE 0 END AS BIGINT))), '') AS varint, printf('%016X', n) AS big_endian, n % 4294967296 AS low, n FROM g",
    "checksums": "WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i))), b AS (SELECT event_id, list_transform(range(1, length(props) + 1), lambda i: CAST(ascii(substr(props, i, 1)) AS BIGINT)) AS b FROM events) SELECT event_id, xor(list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h >> 8, t[xor(h & 255, x) + 1])), 4294967295) AS crc FROM b, t",
    "log_suffix_replacement": f"WITH {_LOGS}, incoming AS (SELECT server, f.idx, l.term, f.idx * 10 AS command FROM follower f JOIN leader l ON f.idx = l.idx WHERE f.idx % 2 = 0), cut AS (SELECT f.server, min(f.idx) AS cut FROM follower f JOIN incoming i ON f.server = i.server AND f.idx = i.idx WHERE f.term <> i.term GROUP BY f.server), kept AS (SELECT f.server, f.idx, f.term, f.idx AS command FROM follower f LEFT JOIN cut c ON f.server = c.server WHERE c.cut IS NULL OR f.idx < c.cut) SELECT * FROM kept UNION ALL SELECT i.* FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.server = i.server AND k.idx = i.idx)",
    "vote_up_to_date": "SELECT a.s_suppkey AS peer, count(b.s_suppkey) AS votes FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND (a.s_suppkey % 3 > b.s_suppkey % 3 OR (a.s_suppkey % 3 = b.s_suppkey % 3 AND a.s_suppkey % 11 >= b.s_suppkey % 11)) GROUP BY a.s_suppkey",
    "election_winners": "SELECT CAST(floor(event_id / 10) AS BIGINT) AS term, user_id % 2 AS candidate, count(DISTINCT event_id % 10) AS votes FROM events WHERE value < 100 GROUP BY ALL HAVING count(DISTINCT event_id % 10) * 2 > 10",
    "election_safety": "SELECT CAST(floor(event_id / 50) AS BIGINT) AS term, count(DISTINCT user_id) AS leaders FROM events WHERE event_type = 'signup' AND value > 150 GROUP BY 1 HAVING count(DISTINCT user_id) > 1",
    "current_leader": "SELECT max_by(server, term) AS leader, count(*) = 0 AS no_leader FROM (SELECT CAST(floor(event_id / 50) AS BIGINT) AS term, min(user_id) AS server FROM events WHERE event_type = 'signup' AND value > 150 GROUP BY 1)",
    "no_leader": "SELECT max_by(user_id, event_id) AS leader, count(*) = 0 AS no_leader FROM events WHERE event_id < 0",
    "leader_hint": "SELECT a.event_id AS id, a.event_id AS ts, (SELECT max_by(c.user_id, c.event_id) FROM events c WHERE c.event_type = 'signup' AND c.value > 150 AND c.event_id <= a.event_id) AS leader FROM events a WHERE a.event_type = 'view'",
    "shard_histogram": "WITH k AS (SELECT DISTINCT 'key-' || CAST(user_id AS VARCHAR) AS key FROM events), h AS (SELECT list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::HUGEINT)), lambda h, b: ((h - h % 256) + xor(h % 256, b)) * 1099511628211 % 18446744073709551616) AS h FROM k) SELECT CAST(h % 128 AS INTEGER) AS shard, count(*) AS keys FROM h GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        kv_materialize, kv_point_get, kv_lookup, kv_multi_get, kv_key_count, kv_tombstones, kv_ordered_scan, kv_delete_keys, kv_put_delete, kv_replayed_log,
        buffer_size, wal_valid_prefix, flush_runs, compact_tier_keep, compact_bottom_drop, tier_pick, tier_runs, read_amplification, block_first_keys, block_floor,
        as_of_lsn, base_plus_tail, manifest_live, orphan_runs, replace_subset, request_totals, latency_histogram, latency_nearest_rank, load_report, write_amp,
        throughput_windows, commit_index, commit_index_by_rank, leader_commit, stale_reply_filter, state_machine_safety, commit_counts, log_first_conflict,
        append_consistency, next_index, log_compaction, snapshot_install, propose, vote_grants, follower_commit, applicable_entries, apply_gaps, silent_gaps, acknowledged,
        append_requests, connected, follow_hints, line_tokens, run_names, numbers_as_bytes, kv_ordered_walk, log_suffix_replacement, vote_up_to_date, election_winners, election_safety, current_leader, no_leader, leader_hint,
        shard_histogram, checksums,
    )
    from tidelog.plans import stores

    return {f.__name__: f for f in found} | stores.queries()


def oracle_sql() -> dict[str, str]:
    from tidelog.plans import stores

    return SQL | stores.SQL
