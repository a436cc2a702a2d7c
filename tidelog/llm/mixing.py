"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Words are dealt in equal blocks. `targets` fixes how many words each source should give: its
weight's share of all words, at most `limit` times what it has. `apportion` then turns shares into
whole blocks by highest quotients w / (2k + 1): first to sources, then each source's blocks to its
shards. Within a shard documents lie in an order drawn from the seed, and the shard gives its quota
from the start of that order, passing over it again where the quota exceeds what it holds.

Nothing here gathers a source in one task: a source is cut into shards of about `shard_rows`
documents by a hash of the id, and single-partition windows see one row for each source only: sources
are named corpora, of which a task can order some million. Rows that repeat one id lie in one shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import n_words, written


def apportion(df: DataFrame, by: Sequence[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: give each group's `seats` to its rows by the highest weight / (2k + 1).

    Equal quotients go to the smaller key. Most seats are settled by rounding the ideal share; only
    the few quotients about the cut are listed and ranked: a group of n rows makes O(n) of them,
    however many seats there are. Weights of zero or less get none.
    """
    g = Window.partitionBy(*by)
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    d = df.withColumns({"_w": w, "_all": F.sum(w).over(g), "_n": F.count(F.lit(1)).over(g)})
    share = F.when(F.col("_all") > 0, F.col("_w") / F.col("_all")).otherwise(0.0)
    d = d.withColumn("_share", share).withColumn("_base", F.floor(F.col(seats) * F.col("_share") + 0.5))
    want = F.when(F.col("_all") > 0, F.col(seats)).otherwise(0)
    d = d.withColumn("_short", want - F.sum("_base").over(g))
    reach = F.ceil(F.col("_share") * (F.abs("_short") + F.col("_n"))) + 2
    more = F.sequence(F.col("_base"), F.col("_base") + reach)
    less = F.sequence(F.greatest(F.col("_base") - reach, F.lit(0)), F.col("_base") - 1)
    steps = F.when((F.col("_short") > 0) & (F.col("_w") > 0), more).when((F.col("_short") < 0) & (F.col("_base") > 0), less).otherwise(F.array().cast("array<bigint>"))
    q = d.select(*by, key, "_short", "_w", F.explode(steps).alias("_k"))
    q = q.withColumn("_q", F.col("_w") / (2 * F.col("_k") + 1))
    up = Window.partitionBy(*by).orderBy(F.desc("_q"), F.asc(key))
    down = Window.partitionBy(*by).orderBy(F.asc("_q"), F.desc(key))
    rank = F.when(F.col("_short") > 0, F.row_number().over(up)).otherwise(F.row_number().over(down))
    q = q.withColumn("_r", rank).where(F.col("_r") <= F.abs("_short"))
    q = q.groupBy(*by, key).agg(F.sum(F.signum("_short")).cast("long").alias("_more"))
    d = d.join(q, [*by, key], "left").withColumn(out, F.col("_base") + F.coalesce("_more", F.lit(0)))
    return d.drop("_w", "_all", "_n", "_share", "_base", "_short", "_more")


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """sources (source, size) with its weight and target words.

    Sources in code-point order, null last, take the weights in turn. Targets share the sum of all
    sizes by weight; one that would pass `limit` x size stops there and the excess is shared again.
    The sources that stop are a prefix by cap / weight, so one ordered pass finds them.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    d = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
    d = d.withColumns({"_cap": F.col("size") * limit, "_total": F.sum("size").over(every)})
    before = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    d = d.withColumn("_stops", F.col("_cap") / F.col("weight") <= F.col("_level"))
    level = F.max(F.when(~F.col("_stops"), F.col("_level"))).over(every)
    d = d.withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(level * F.col("weight")))
    return d.drop("_cap", "_total", "_level", "_stops")


def draw(seed: int, doc_id: Column) -> Column:
    """32 hex digits that order documents and deal them to buckets."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, carry: Sequence[str] = (), weights: Sequence[int] = (5, 2, 1), limit: float = 3.0, block: int = 64, shard_rows: int = 4096, seed: int = 42) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns doc_id, source, carried (a struct of the columns asked for, if any), size, source_size,
    target, shard, quota (its blocks), copies (whole documents, nearest to taken) and taken. taken is passes x size plus the part of the
    document that lies before the shard's cut, so no document passes limit x size.

    A null text has no words; a null source is a source of its own, after all others; documents
    without words take 0; an empty table gives an empty result; repeated rows are documents of their
    own; equal ids are ordered by size, so a rerun takes the same words. Other columns play no part,
    whatever their names.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    drawn = draw(seed, F.col("doc_id"))
    d = docs.select(F.col("doc_id"), F.col("source"), *([F.struct(*carry).alias("carried")] if carry else []), n_words(F.col("text")).alias("size"), key.alias("_key"), drawn.alias("_draw"))
    d = written(d, "mix-sizes")  # texts are split once
    sources = d.groupBy("_key", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    sources = written(targets(sources, weights, limit), "mix-targets")
    sources = sources.withColumn("_blocks", F.round(F.sum("size").over(Window.partitionBy()) / block).cast("long"))
    sources = apportion(sources.withColumn("_one", F.lit(1)), ["_one"], "_key", "target", "_blocks", "_quota")
    plan = written(sources.select("_key", F.col("size").alias("source_size"), "target", "_quota", F.ceil(F.col("rows") / shard_rows).cast("long").alias("_shards")), "mix-sources")
    d = d.join(plan, "_key").withColumn("shard", F.conv(F.substring("_draw", 1, 12), 16, 10).cast("long") % F.col("_shards"))
    shards = written(d.groupBy("_key", "_quota", "shard").agg(F.sum("size").alias("_size")), "mix-shards")
    shards = apportion(shards, ["_key"], "shard", "_size", "_quota", "quota").select("_key", "shard", "_size", "quota")
    shards = shards.withColumn("_take", F.least(F.col("quota") * block, F.floor(F.col("_size") * limit)))
    d = d.drop("_quota")
    run = Window.partitionBy("_key", "shard").orderBy("_draw", F.col("doc_id").asc_nulls_first(), "size")
    d = d.withColumn("_end", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(shards, ["_key", "shard"])
    left = F.col("_take") - F.expr("_take div greatest(_size, 1)") * F.col("_size") - (F.col("_end") - F.col("size"))
    part = F.greatest(F.least(left, F.col("size")), F.lit(0))
    d = d.withColumn("taken", (F.expr("_take div greatest(_size, 1)") * F.col("size") + part).cast("long"))
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
    return d.drop("_key", "_draw", "_shards", "_end", "_size", "_take")
