"""Operational metrics over a request log: counters, histograms, percentiles, throughput, amplification."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The default bucket bounds of Prometheus histograms, in seconds.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def request_totals(log: DataFrame) -> DataFrame:
    """Requests by op and result."""
    return log.groupBy("op", "result").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(log: DataFrame, by: Sequence[str], value: str, buckets: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    """Cumulative counts of value <= le, with +Inf, and the sum, by group: one pass, no join with the buckets."""
    counts = [F.count_if(F.col(value) <= F.lit(float(b))).alias(f"_{i}") for i, b in enumerate(buckets)]
    d = log.groupBy(*by).agg(*counts, F.count(value).alias("_all"), F.sum(value).alias("sum"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("hits")) for i, b in enumerate(buckets)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("hits")))
    return d.select(*by, "sum", F.explode(F.array(*cells)).alias("b")).select(*by, "b.le", "b.hits", "sum")


def nearest_rank(log: DataFrame, by: Sequence[str], value: str, ps: Sequence[float] = (0.5, 0.9, 0.99), bins: int = 4096) -> DataFrame:
    """By group: n, max and for each p the value at place min(floor(p * n), n - 1) of the sorted values.

    Each group's range is cut into bins, whose counts say which bin holds each place; only the distinct values
    of those bins are sorted. No task sorts a group, whether it holds few values or as many as rows.
    """
    name = lambda p: f"p{p * 100:g}".replace(".", "_")
    d = log.where(F.col(value).isNotNull()).select(*by, value)
    key = [F.col(c) for c in by]
    ends = d.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_n"))
    ends = ends.select(*(c.alias(f"_by{i}") for i, c in enumerate(key)), "_low", "_high", "_n")
    same = lambda a, b: functools.reduce(Column.__and__, (F.col(f"{a}{i}").eqNullSafe(F.col(f"{b}{i}")) for i in range(len(by))), F.lit(True))
    h = d.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")).select(*(c.alias(f"_k{i}") for i, c in enumerate(key)), F.col(value).alias("_v"), "_c")
    width = (F.col("_high").cast("double") - F.col("_low").cast("double")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_v").cast("double") - F.col("_low").cast("double")) / width), F.lit(bins - 1))).otherwise(0)
    h = h.join(ends, same("_k", "_by")).withColumn("_bin", place)
    groups = [f"_by{i}" for i in range(len(by))]
    counts = h.groupBy(*groups, "_low", "_high", "_n", "_bin").agg(F.sum("_c").alias("_c"))
    counts = counts.withColumn("_end", F.sum("_c").over(Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1).alias("r")) for i, p in enumerate(ps)))
    asked = F.filter(ranks, lambda x: (x["r"] < F.col("_end")) & (x["r"] >= F.col("_end") - F.col("_c")))
    picked = counts.withColumn("_asked", asked).where(F.size("_asked") > 0).select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_bin").alias("_at"), "_asked", (F.col("_end") - F.col("_c")).alias("_before"))
    run = Window.partitionBy(*groups, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inner = h.join(picked, same("_by", "_g") & (F.col("_bin") == F.col("_at"))).withColumn("_end", F.col("_before") + F.sum("_c").over(run))
    at = lambda i: F.min(F.when(F.exists("_asked", lambda x: (x["i"] == i) & (x["r"] < F.col("_end"))), F.col("_v")))
    out = inner.groupBy(*groups).agg(F.max("_n").alias("n"), *(at(i).alias(name(p)) for i, p in enumerate(ps)), F.max("_high").alias("max"))
    return out.select(*(F.col(g).alias(c) for g, c in zip(groups, by, strict=True)), "n", *(name(p) for p in ps), "max")


def load_report(log: DataFrame, seconds: float) -> DataFrame:
    """One row: ops, errors, ops per configured second (failures count), integer mean and max latency, writes. log: latency_ns, is_write, error."""
    ops = F.count(F.lit(1))
    return log.agg(ops.alias("ops"), F.count_if("error").alias("errors"), (ops / F.lit(float(seconds))).alias("ops_per_s"), F.expr("sum(latency_ns) div count(1)").alias("mean_ns"), F.max("latency_ns").alias("max_ns"), F.count_if("is_write").alias("writes"))


def throughput(log: DataFrame, unit: str = "hour", ts: str = "ts") -> DataFrame:
    """Requests of each hour (or minute, day) and the rate per second."""
    seconds = {"minute": 60.0, "hour": 3600.0, "day": 86400.0}[unit]
    return log.groupBy(F.date_trunc(unit, ts).alias("window_start")).agg(F.count(F.lit(1)).alias("ops")).withColumn("ops_per_s", F.col("ops") / seconds)


def write_amplification(log: DataFrame, size: Column, levels: Sequence[Sequence[str]]) -> DataFrame:
    """One row: bytes written over bytes put. Each level rewrites one version of each of its distinct key columns; the log itself is written once."""
    once = [log.select(*k, size.alias("_b")).groupBy(*k).agg(F.max("_b").alias("_b")).agg(F.sum("_b").alias("_w")) for k in levels]
    total = log.agg(F.sum(size).alias("logical"))
    out = total.withColumn("written", F.col("logical"))
    for o in once:  # one-row tables
        out = out.join(F.broadcast(o)).withColumn("written", F.col("written") + F.col("_w")).drop("_w")
    return out.select((F.col("written").cast("double") / F.col("logical").cast("double")).alias("amplification"))


def live_keys_over_time(log: DataFrame, ts: str = "ts", unit: str = "hour") -> DataFrame:
    """window_start and live_keys: keys that are live at the end of each hour (or minute, day) with mutations. log: key, lsn, tombstone and a time that follows lsn.

    Each mutation adds or takes a key, or neither; the running sum sees a row a window.
    """
    was = F.coalesce(~F.lag("tombstone").over(Window.partitionBy("key").orderBy("lsn")), F.lit(False))
    change = (~F.col("tombstone")).cast("long") - was.cast("long")
    sums = log.withColumn("_c", change).groupBy(F.date_trunc(unit, ts).alias("window_start")).agg(F.sum("_c").alias("_c"))
    run = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("window_start", F.sum("_c").over(run).alias("live_keys"))


def gauge(read: Callable[[], int]) -> int:
    """A gauge's number now; -1 where it can't be read, so a scrape never fails."""
    try:
        return int(read())
    except Exception:
        return -1


def workload(ids: DataFrame, keys: int = 10_000, put_percent: int = 50, seed: int = 1) -> DataFrame:
    """op_no, op and key of a load of puts and gets on random keys, drawn by MD5 and so the same anywhere. ids: op_no."""
    draw = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(what), F.lit(str(seed)), F.col("op_no").cast("string"))), 1, 12), 16, 10).cast("long")
    return ids.select("op_no", F.when(draw("op") % 100 < put_percent, "put").otherwise("get").alias("op"), F.concat(F.lit("key-"), (draw("key") % keys).cast("string")).alias("key"))


def unreliable(messages: DataFrame, seed: int = 1) -> DataFrame:
    """What a bad network makes of messages (id, sent_ms): lost requests and replies, delays; outcome and arrived_ms, drawn by MD5.

    Fixed values: requests take 0 to 26 ms, a tenth of them and of the replies is lost, and two thirds of the
    replies come 200 to 2199 ms late.
    """
    draw = lambda what, n: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(what), F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long") % n
    outcome = F.when(draw("request", 1000) < 100, "request_lost").when(draw("reply", 1000) < 100, "reply_lost").otherwise("delivered")
    wait = draw("delay", 27) + F.when(draw("late", 900) < 600, 200 + draw("by", 2000)).otherwise(0)
    d = messages.withColumn("outcome", outcome)
    return d.withColumn("arrived_ms", F.when(F.col("outcome") == "delivered", F.col("sent_ms") + wait))


def process_io() -> dict[str, int]:
    """The driver process's own counters of bytes read and written, where the system tells them; empty elsewhere."""
    try:
        with open("/proc/self/io") as f:
            return {k: int(v) for k, v in (line.split(": ") for line in f)}
    except OSError:
        return {}
