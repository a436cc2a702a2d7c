"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import scratch
from tidelog.session import discard


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v.

    The least neighbour comes from an aggregate, not a window, so a node with a third of all links is
    summed where its rows lie, and the join that follows can be split by adaptive execution.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node and component (its least node) for every node of edges (u, v), both long, but the least ones themselves.

    Null ends and self-links are dropped, repeated and reversed links count once. Each round is a table
    in the shared folder, so lost executors cost a round at most and the lineage stays short.
    """
    spark = edges.sparkSession
    d = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen, old = None, None
    for _ in range(most_rounds):
        path = scratch(spark, "stars")
        d.write.parquet(path)
        now = spark.read.schema(d.schema).parquet(path)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old:
            discard(spark, old)
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, old, d = mark, path, _stars(now)
    raise RuntimeError("links did not settle")
