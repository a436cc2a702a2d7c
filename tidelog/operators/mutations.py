"""A key-value table as the last-writer-wins reading of a mutation log.

A mutation is (key, lsn, tombstone, value): lsn orders the mutations of a key and is unique for it.
Recency is the lsn of a record, never the order of files, so no interleaving of flushes and merges can
bring an old value back. An empty value is a live row; a deleted or absent key is no row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mutation_view(df: DataFrame, key: Column, lsn: Column, tombstone: Column, value: Column, *more: Column) -> DataFrame:
    """df as mutations. The value of a tombstone is null."""
    return df.select(key.alias("key"), lsn.cast("long").alias("lsn"), tombstone.alias("tombstone"), F.when(~tombstone, value).alias("value"), *more)


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with a put for each of rows (key, lsn, value)."""
    return log.unionByName(rows.select("key", "lsn", F.lit(False).alias("tombstone"), "value"))


def delete(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with a delete for each of rows (key, lsn); deleting a missing key is no error and still leaves a tombstone."""
    value = log.schema["value"].dataType
    return log.unionByName(rows.select("key", "lsn", F.lit(True).alias("tombstone"), F.lit(None).cast(value).alias("value")))


def delete_keys(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """A snapshot without the keys: physical removal, no tombstone."""
    return snapshot.join(keys.select("key").distinct(), "key", "left_anti")


def latest(log: DataFrame, *group: str) -> DataFrame:
    """The newest mutation of each key (and group), tombstones kept.

    row_number() = 1 plans to a limit before and after one exchange on the key, so a hot key sends a row
    a task. An lsn is one mutation's; should it repeat, the delete counts. Values of any type are not compared.
    """
    order = [F.desc("lsn"), F.desc("tombstone")]
    rank = F.row_number().over(Window.partitionBy(*group, "key").orderBy(*order))
    return log.withColumn("_r", rank).where("_r = 1").drop("_r")


def materialize(log: DataFrame) -> DataFrame:
    """Live rows: the newest mutation of each key, unless it is a delete."""
    return latest(log).where(~F.col("tombstone")).drop("tombstone")


def get(log: DataFrame, key) -> DataFrame:
    """The live row of one key, or none; the filter reaches the scan."""
    return materialize(log.where(F.col("key") == F.lit(key)))


def lookup(log: DataFrame, key) -> DataFrame:
    """found, tombstone and value of one key: the three-valued answer of a single run."""
    hit = latest(log.where(F.col("key") == F.lit(key)))
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"), F.coalesce(F.max("tombstone"), F.lit(False)).alias("tombstone"), F.max("value").alias("value"))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found, tombstone and value for each of keys. The log is first cut to those keys, before the reduce."""
    keys = keys.select("key").distinct()
    hit = latest(log.join(keys, "key", "left_semi")).select("key", F.lit(True).alias("found"), "tombstone", "value")
    return keys.join(hit, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "tombstone", "value")


def key_count(log: DataFrame) -> DataFrame:
    """One row: live keys. Values are not read."""
    return materialize(log.drop("value").withColumn("value", F.lit(0))).agg(F.count(F.lit(1)).alias("live_keys"))


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest mutation is a delete."""
    return latest(log).where("tombstone").select("key", "lsn")


def ordered_scan(log: DataFrame, low=None, high=None) -> DataFrame:
    """Live rows with low <= key < high in byte order."""
    d = log
    if low is not None:
        d = d.where(F.col("key") >= F.lit(low))
    if high is not None:
        d = d.where(F.col("key") < F.lit(high))
    return materialize(d).orderBy("key")


def placed(rows: DataFrame, prefix: int = 2) -> DataFrame:
    """Rows with their place in the byte order of their keys, from 1.

    Keys are numbered within each prefix of so many characters; the prefixes' counts, a row each, give the
    place where it starts. No task sorts all rows.
    """
    d = rows.withColumn("_p", F.substring("key", 1, prefix))
    counts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    n = F.row_number().over(Window.partitionBy("_p").orderBy("key"))
    return d.withColumn("_n", n).join(starts, "_p").withColumn("place", F.col("_start") + F.col("_n")).drop("_p", "_n", "_start")


def as_of(log: DataFrame, lsn: int) -> DataFrame:
    """Live rows as they were once `lsn` had been applied."""
    return materialize(log.where(F.col("lsn") <= lsn))


def base_plus_tail(base: DataFrame, log: DataFrame, lsn: int) -> DataFrame:
    """Live rows from a snapshot taken at `lsn` and the mutations after it. base: key, lsn, value."""
    return materialize(base.select("key", "lsn", F.lit(False).alias("tombstone"), "value").unionByName(log.where(F.col("lsn") > lsn)))


def buffer_size(log: DataFrame, value_bytes: Column | None = None) -> DataFrame:
    """One row: bytes of distinct keys and of their newest values. An overwrite counts the new value only."""
    size = value_bytes if value_bytes is not None else F.octet_length("value")
    return latest(log).agg(F.sum(F.octet_length("key") + F.when(F.col("tombstone"), 0).otherwise(F.coalesce(size, F.lit(0)))).cast("long").alias("bytes"))


def deduplicate(log: DataFrame) -> DataFrame:
    """A log in which a replayed (key, lsn) counts once."""
    return log.dropDuplicates(["key", "lsn"])


def merge_snapshots(parts: Iterable[DataFrame]) -> DataFrame:
    """Live rows of several logs or runs, whatever order they come in."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out)
