"""Removal of lines that spread over many sites.

A line's spread is the number of distinct sites (sources) that hold it. HyperLogLog sketches of the
sites, one a line hash, merge by aggregation; a line whose estimate lies within the sketch's error of
the threshold gets an exact distinct count. Sketches are first made where the lines lie, so a line
that a third of the documents hold costs a row a task; lines in fewer documents than the threshold
asks sites for cannot reach it and go before anything is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import written

LG_K = 10  # log2 of a sketch's registers
SIGMAS = 4  # width of the band that is counted exactly, in standard errors


def hashes(text: Column) -> Column:
    """The hash of each line of text, without white space at its ends; null for a blank line."""
    bare = lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(F.length(bare(x)) > 0, F.xxhash64(bare(x))))


def spread(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """hash, first (smallest doc_id) of every line that min_sites sites or more hold. docs: doc_id, source, h (a row for each line of a document)."""
    held = docs.groupBy("h").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    sketches = written(held.where(F.col("n") >= min_sites).select("h", "first", F.hll_sketch_estimate("sketch").alias("sites")), "line-sketches")
    error = 1 + SIGMAS * 1.04 / 2 ** (LG_K / 2)
    sure = sketches.where(F.col("sites") > min_sites * error)
    near = sketches.where((F.col("sites") <= min_sites * error) & (F.col("sites") * error >= min_sites - 1))
    counted = docs.join(near.select("h", "first"), "h").groupBy("h", "first", "source").agg(F.lit(1).alias("one")).groupBy("h", "first").agg(F.count("source").alias("sites"))
    return sure.select("h", "first").union(counted.where(F.col("sites") >= min_sites).select("h", "first"))


def without_boilerplate(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """docs with lines that min_sites sources or more hold taken out of all documents but the first.

    The document with the smallest doc_id keeps such a line, so a text that many sites copy loses none
    of its lines everywhere. Adds n_lines and n_removed; text is untouched, byte for byte, where
    nothing goes. Lines are compared without white space at their ends, by 64-bit hashes (n lines and m
    that go make a wrong removal with probability n * m / 2^64); blank lines are never removed.
    Null text stays null and has no lines. A null source is no site. A null doc_id comes after all
    others: its lines go if any other id holds them. Rows with one id count as one document. Columns
    n_lines and n_removed of the input are replaced; others stay, whatever their names.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = docs.select("doc_id", "source", F.explode(F.array_compact(F.array_distinct(hashes(F.col("text"))))).alias("h"))
    lines = written(lines, "lines")
    found = spread(lines, min_sites)
    gone = lines.join(found, "h").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("h").alias("_gone"))
    d = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    parts = F.split("text", "\n")
    kept = F.transform(F.filter(F.arrays_zip(parts.alias("line"), hashes(F.col("text")).alias("hash")), lambda x: x["hash"].isNull() | ~F.array_contains(F.col("_gone"), x["hash"])), lambda x: x["line"])
    d = d.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)))
    d = d.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    d = d.withColumn("n_removed", F.when(F.col("_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")))
    return d.withColumn("text", F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))).drop("_kept", "_gone")
