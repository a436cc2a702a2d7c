"""Analytics over replicated-log traces: votes, quorum commit, divergence, snapshots and safety audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def propose(log: DataFrame, commands: DataFrame, order: str) -> DataFrame:
    """commands with the index each gets in its group: the group's last index, plus its place. log: group_id, idx."""
    last = log.groupBy("group_id").agg(F.max("idx").alias("_last"))
    n = F.row_number().over(Window.partitionBy("group_id").orderBy(order))
    return commands.withColumn("_n", n).join(last, "group_id", "left").withColumn("idx", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")


def up_to_date(last_term: Column, last_index: Column, own_term: Column, own_index: Column) -> Column:
    """Whether a candidate's log is at least as new as the voter's: terms first, then indexes."""
    return F.struct(last_term.alias("t"), last_index.alias("i")) >= F.struct(own_term.alias("t"), own_index.alias("i"))


def possible_votes(peers: DataFrame) -> DataFrame:
    """peer and votes: how many others of its group have a log that is no newer than its own. peers: group_id, peer, last_term, last_index.

    Equal logs are counted once and summed from below, so no pair of peers is made.
    """
    at = peers.groupBy("group_id", "last_term", "last_index").agg(F.count(F.lit(1)).alias("_c"))
    below = Window.partitionBy("group_id").orderBy("last_term", "last_index").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("_b", F.sum("_c").over(below)).drop("_c")
    return peers.join(at, ["group_id", "last_term", "last_index"]).select("peer", (F.col("_b") - 1).alias("votes"))


def grants(requests: DataFrame) -> DataFrame:
    """granted for each vote request (term, candidate, last_term, last_index, own_term, voted_for, own_last_term, own_last_index).

    A newer term clears the voter's vote; an older one is refused.
    """
    free = (F.col("term") > F.col("own_term")) | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    ok = up_to_date(F.col("last_term"), F.col("last_index"), F.col("own_last_term"), F.col("own_last_index"))
    return requests.withColumn("granted", (F.col("term") >= F.col("own_term")) & free & ok)


def election_winners(votes: DataFrame, peers: int) -> DataFrame:
    """(term, candidate) with votes of more than half of the peers. votes: term, candidate, voter, granted."""
    won = votes.where("granted").groupBy("term", "candidate").agg(F.countDistinct("voter").alias("votes"))
    return won.where(F.col("votes") * 2 > peers)


def append_check(appends: DataFrame, log: DataFrame) -> DataFrame:
    """For each append (id, server, prev_idx, prev_term) against log (server, idx, term): ok, conflict_term, conflict_index.

    Index 0 always matches. Past the end: conflict_index is the length, no term. A wrong term: that term and
    the first index that has it. A previous index below the log's first (compacted) entry is refused at that entry.
    """
    ends = log.groupBy("server").agg(F.max("idx").alias("_last"), F.min("idx").alias("_base"))
    terms = log.groupBy("server", F.col("term").alias("_term")).agg(F.min("idx").alias("_first"))
    here = log.select("server", F.col("idx").alias("prev_idx"), F.col("term").alias("_term"))
    d = appends.join(here, ["server", "prev_idx"], "left").join(ends, "server", "left").join(terms, ["server", "_term"], "left")
    ok = (F.col("prev_idx") == 0) | F.coalesce(F.col("_term") == F.col("prev_term"), F.lit(False))
    past = F.col("prev_idx") > F.coalesce("_last", F.lit(0))
    return d.select(
        "id", "server", ok.alias("ok"),
        F.when(~ok & ~past, F.col("_term")).alias("conflict_term"),
        F.when(ok, None).when(past, F.coalesce("_last", F.lit(0)) + 1).otherwise(F.coalesce("_first", "_base")).alias("conflict_index"),
    )


def first_conflict(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """server, idx: the first index at which a follower's term differs from the leader's. leader: idx, term; follower: server, idx, term."""
    d = follower.alias("f").join(leader.alias("l"), "idx").where("l.term <> f.term")
    return d.groupBy("server").agg(F.min("idx").alias("idx"))


def after_append(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """A server's log once entries are appended: cut from the first differing term on, a matching suffix stays. Both: server, idx, term, command."""
    clash = log.alias("a").join(incoming.alias("b"), ["server", "idx"]).where("a.term <> b.term").groupBy("server").agg(F.min("idx").alias("_cut"))
    kept = log.join(clash, "server", "left").where(F.col("_cut").isNull() | (F.col("idx") < F.col("_cut"))).drop("_cut")
    return kept.unionByName(incoming.join(kept.select("server", "idx"), ["server", "idx"], "left_anti").select(kept.columns))


def follower_commit(commit: Column, leader_commit: Column, prev: Column, entries: Column) -> Column:
    """A follower's commit index after an append: the leader's, at most the last new entry, and never less than before."""
    return F.when(leader_commit > commit, F.greatest(commit, F.least(leader_commit, prev + entries))).otherwise(commit)


def commit_index(progress: DataFrame) -> DataFrame:
    """group_id, commit_index: the largest index that more than half of the peers match. progress: group_id, peer, match_index.

    By rank: the match in descending place floor(n / 2) + 1.
    """
    w = Window.partitionBy("group_id")
    d = progress.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("match_index"), "peer")), "_n": F.count(F.lit(1)).over(w)})
    return d.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select("group_id", F.col("match_index").alias("commit_index"))


def commit_index_by_count(progress: DataFrame) -> DataFrame:
    """The same by counting, for each match, the distinct peers at or beyond it: equal matches are counted once, then summed from above."""
    n = progress.groupBy("group_id").agg(F.countDistinct("peer").alias("_n"))
    at = progress.groupBy("group_id", "match_index").agg(F.countDistinct("peer").alias("_c"))
    beyond = F.sum("_c").over(Window.partitionBy("group_id").orderBy(F.desc("match_index")).rowsBetween(Window.unboundedPreceding, 0))
    d = at.withColumn("_b", beyond).join(n, "group_id").where(F.col("_b") * 2 > F.col("_n"))
    return d.groupBy("group_id").agg(F.max("match_index").alias("commit_index"))


def leader_commit(progress: DataFrame, log: DataFrame, current_term: int) -> DataFrame:
    """The quorum index where its entry is of the leader's current term, else none. log: group_id, idx, term."""
    q = commit_index(progress)
    t = log.select("group_id", F.col("idx").alias("commit_index"), "term")
    return q.join(t, ["group_id", "commit_index"]).where(F.col("term") == current_term).drop("term")


def applicable(log: DataFrame, applied: Column, commit: Column) -> DataFrame:
    """Entries in (applied, commit], to be applied in order of idx."""
    return log.where((F.col("idx") > applied) & (F.col("idx") <= commit))


def apply_gaps(applied: DataFrame) -> DataFrame:
    """Places where a server did not apply the next index, in order of arrival. applied: server, arrival, idx."""
    before = F.lag("idx").over(Window.partitionBy("server").orderBy("arrival"))
    return applied.withColumn("expected", before + 1).where(F.col("expected").isNotNull() & (F.col("idx") != F.col("expected")))


def next_index(rejections: DataFrame, leader: DataFrame) -> DataFrame:
    """Where the leader goes back to: after its last entry of the conflict term, else the conflict index, 1 at least.

    rejections: id, conflict_term, conflict_index; leader: idx, term.
    """
    last = leader.groupBy(F.col("term").alias("conflict_term")).agg((F.max("idx") + 1).alias("_next"))
    return rejections.join(last, "conflict_term", "left").select("id", F.greatest(F.coalesce("_next", "conflict_index"), F.lit(1)).alias("next_index"))


def fresh_replies(replies: DataFrame) -> DataFrame:
    """Replies that are newer than all that came before from their peer. replies: peer, arrival, seq."""
    w = Window.partitionBy("peer").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return replies.withColumn("_top", F.max("seq").over(w)).where(F.col("_top").isNull() | (F.col("seq") > F.col("_top"))).drop("_top")


def compact_log(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Logs (server, idx, term) after snapshots (server, index, last_applied), with `sentinel`.

    What a snapshot covers goes, but for the entry at its index, which stays as the sentinel that keeps
    the term before the log's first entry. A snapshot at or below the log's base, or beyond what its server
    has applied, changes nothing; nor does a server without one.
    """
    base = log.groupBy("server").agg(F.min("idx").alias("_base"))
    s = snapshots.join(base, "server").where((F.col("index") > F.col("_base")) & (F.col("index") <= F.col("last_applied"))).select("server", F.col("index").alias("_at"))
    d = log.join(s, "server", "left").where(F.col("_at").isNull() | (F.col("idx") >= F.col("_at")))
    return d.withColumn("sentinel", F.coalesce(F.col("idx") == F.col("_at"), F.lit(False))).drop("_at")


def install_snapshot(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Logs after snapshots (server, last_included, included_term): the suffix stays where the entry at last_included has that term, else nothing does. A snapshot older than the log's base changes nothing."""
    base = log.groupBy("server").agg(F.min("idx").alias("_base"))
    match = log.select("server", F.col("idx").alias("last_included"), F.col("term").alias("_t"))
    s = snapshots.join(match, ["server", "last_included"], "left").join(base, "server", "left")
    s = s.select("server", "last_included", F.coalesce(F.col("_t") == F.col("included_term"), F.lit(False)).alias("_same"), (F.col("last_included") < F.col("_base")).alias("_old"))
    d = log.join(s, "server", "left")
    keep = F.col("last_included").isNull() | F.col("_old") | (F.col("_same") & (F.col("idx") > F.col("last_included")))
    return d.where(keep).drop("last_included", "_same", "_old")


def leader_at(requests: DataFrame, changes: DataFrame, width: float) -> DataFrame:
    """requests (id, ts) with the leader that the last change (ts, leader) before or at ts made; null before the first. ts: a number, or a timestamp and width in seconds.

    Time is cut into spans of `width`. Each is one group, and the last leader of every span, a row each, is
    carried into the spans after it; no task sees more than a span or the list of spans.
    """
    kind = changes.schema["leader"].dataType
    d = requests.select("id", "ts", F.lit(None).cast(kind).alias("leader"), F.lit(1).alias("_k")).unionByName(changes.select(F.lit(None).cast(requests.schema["id"].dataType).alias("id"), "ts", "leader", F.lit(0).alias("_k")))
    d = d.withColumn("_span", F.floor(F.col("ts").cast("double") / width))
    ends = d.groupBy("_span").agg(F.max_by("leader", F.when(F.col("leader").isNotNull(), F.col("ts"))).alias("_end"))
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    w = Window.partitionBy("_span").orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("leader", F.last("leader", ignorenulls=True).over(w)).where("_k = 1").join(carried, "_span")
    return d.select("id", "ts", F.coalesce("leader", "_carried").alias("leader"))


def silent_gaps(beats: DataFrame, timeout: str) -> DataFrame:
    """Spans of a server's heartbeats (server, ts) without a gap of `timeout`, an interval such as '300 milliseconds'."""
    return beats.groupBy("server", F.session_window("ts", timeout).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select("server", "w.start", "w.end", "beats")


def safety_violations(applied: DataFrame) -> DataFrame:
    """Indexes at which servers applied different commands. applied: idx, command."""
    return applied.groupBy("idx").agg(F.countDistinct("command").alias("commands")).where("commands > 1")


def commit_counts(applied: DataFrame) -> DataFrame:
    """For each index, the servers that applied it and the distinct commands they applied. applied: server, idx, command.

    Pairs are made distinct first, so both counts come from one aggregate without copying rows.
    """
    pairs = applied.groupBy("idx", "server", "command").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("idx").agg(F.size(F.collect_set("server")).cast("long").alias("servers"), F.size(F.collect_set("command")).cast("long").alias("commands"))


def acknowledged(proposals: DataFrame, applied: DataFrame, seconds: float = 2.0) -> DataFrame:
    """id and outcome of proposals (id, server, idx, term, ts) against what their servers applied (server, idx, term, ts).

    ok: the entry applied at the index has the proposal's term, in time. not_leader: it has another, as the
    leader changed. error: nothing was applied there in time.
    """
    a = applied.select("server", "idx", F.col("term").alias("_term"), F.col("ts").alias("_at"))
    late = F.col("_at") > F.col("ts") + F.make_interval(secs=F.lit(seconds))
    outcome = F.when(F.col("_at").isNull() | late, "error").when(F.col("term") == F.col("_term"), "ok").otherwise("not_leader")
    return proposals.join(a, ["server", "idx"], "left").select("id", outcome.alias("outcome"))


def election_violations(claims: DataFrame) -> DataFrame:
    """Terms that more than one server claims to lead. claims: term, server."""
    return claims.groupBy("term").agg(F.countDistinct("server").alias("leaders")).where("leaders > 1")


def current_leader(claims: DataFrame) -> DataFrame:
    """One row: the leader of the highest term (null without claims) and whether there is none."""
    return claims.agg(F.max_by("server", "term").alias("leader"), (F.count(F.lit(1)) == 0).alias("no_leader"))


def append_requests(leader: DataFrame, progress: DataFrame) -> DataFrame:
    """What a leader sends each peer in a round: peer, prev_idx, prev_term, entries, and whether it must be a snapshot.

    leader: idx, term; progress: peer, next_index. Entries from next_index on are due; where the entry before is
    compacted away (below the log's first), only a snapshot can help. Index 0 has term 0.
    """
    ends = leader.agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"))
    d = progress.join(F.broadcast(ends)).withColumn("prev_idx", F.col("next_index") - 1)  # one row
    d = d.join(leader.select(F.col("idx").alias("prev_idx"), F.col("term").alias("_term")), "prev_idx", "left")
    snapshot = (F.col("prev_idx") < F.col("_first")) & (F.col("prev_idx") > 0)
    return d.select("peer", "prev_idx", F.when(F.col("prev_idx") == 0, 0).otherwise(F.col("_term")).cast("long").alias("prev_term"), F.greatest(F.col("_last") - F.col("prev_idx"), F.lit(0)).alias("entries"), snapshot.alias("snapshot"))


def connected(toggles: DataFrame, peers: int) -> DataFrame:
    """server, links and majority: how many others each server's last known links reach, and whether that makes a quorum with itself.

    toggles: a, b, at, up (links are of both directions). A link that was never named is down.
    """
    both = toggles.select("a", "b", "at", "up").unionByName(toggles.select(F.col("b").alias("a"), F.col("a").alias("b"), "at", "up")).where("a <> b")
    last = both.groupBy(F.col("a").alias("server"), "b").agg(F.max_by("up", "at").alias("up"))
    d = last.groupBy("server").agg(F.count_if("up").alias("links"))
    return d.withColumn("majority", (F.col("links") + 1) * 2 > peers)


def follow_hints(asks: DataFrame, hints: DataFrame, most: int = 8) -> DataFrame:
    """id, leader and redirects of asks (id, server) that follow hints (server, hint) until a server names itself or none; leader is null after `most` redirects.

    Servers are few, so their chains are followed by joins of hints with hints; asks are joined once.
    """
    at = hints.select("server", F.col("server").alias("_at"), F.lit(0).alias("redirects"))
    nxt = hints.select(F.col("server").alias("_at"), F.when(F.col("hint") != F.col("server"), F.col("hint")).alias("_to"))
    for _ in range(most):
        at = at.join(nxt, "_at", "left").select("server", F.coalesce("_to", "_at").alias("_at"), (F.col("redirects") + F.col("_to").isNotNull().cast("int")).alias("redirects"))
    at = at.join(nxt, "_at", "left").select("server", F.when(F.col("_to").isNull(), F.col("_at")).alias("leader"), "redirects")
    d = asks.join(at, "server", "left")
    known = F.col("redirects").isNotNull()
    return d.select("id", F.when(known, F.col("leader")).otherwise(F.col("server")).alias("leader"), F.coalesce("redirects", F.lit(0)).alias("redirects"))


def save_state(states: DataFrame, logs: DataFrame, store) -> None:
    """Make (server, term, voted_for, last_included) and the logs (server, idx, term, command) durable together.

    Both are one run of a RunStore with string values: keys s/<server> and l/<server>/<index>. A save
    replaces what is there, entries that the logs no longer hold included, and is one manifest file.
    """
    s = states.select(F.concat(F.lit("s/"), F.col("server").cast("string")).alias("key"), F.to_json(F.struct("term", "voted_for", "last_included")).alias("value"))
    entry = F.concat_ws("/", F.lit("l"), F.col("server").cast("string"), F.lpad(F.col("idx").cast("string"), 19, "0"))
    rows = s.unionByName(logs.select(entry.alias("key"), F.to_json(F.struct("term", "command")).alias("value")))
    store.replace(rows.select("key", F.lit(0).cast("long").alias("lsn"), F.lit(False).alias("tombstone"), "value"))


def load_state(store) -> tuple[DataFrame, DataFrame]:
    """What save_state has last made durable: states and logs; empty ones where nothing has."""
    d = store.read()
    server = F.split("key", "/")[1].cast("int")
    states = d.where(F.col("key").startswith("s/")).select(server.alias("server"), F.from_json("value", "term long, voted_for int, last_included long").alias("v")).select("server", "v.*")
    logs = d.where(F.col("key").startswith("l/")).select(server.alias("server"), F.split("key", "/")[2].cast("long").alias("idx"), F.from_json("value", "term long, command string").alias("v")).select("server", "idx", "v.*")
    return states, logs
