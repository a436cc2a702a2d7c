"""Sorted immutable runs, size-tiered compaction and removal of tombstones.

A run is a Parquet folder sorted by key, so row-group statistics prune point and range reads. Which
runs are live is what the manifest says (see manifest.py); a merge is published in one manifest file.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.manifest import Manifest
from tidelog.operators.mutations import latest

FANOUT = 4


def merge(log: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """The newest mutation of each key over all runs. Tombstones go only after the reduce."""
    out = latest(log)
    return out.where(~F.col("tombstone")) if drop_tombstones else out


def pick_tier(runs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row: the lowest tier with `fanout` runs or more, or null. runs: gen, seq."""
    return runs.groupBy("gen").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fanout).agg(F.min("gen").alias("gen"))


def may_drop(runs: DataFrame, gen: int) -> bool:
    """Whether a merge of all runs of tier gen may drop tombstones: no older tier holds a run, so nothing they hide is left."""
    return runs.where(F.col("gen") > gen).limit(1).count() == 0


def read_amplification(log: DataFrame, run: str = "run") -> DataFrame:
    """Runs and versions that a reader of each key meets."""
    return log.groupBy("key").agg(F.countDistinct(run).alias("runs"), F.count(F.lit(1)).alias("versions"))


def block_ranges(entries: DataFrame, block_rows: int) -> DataFrame:
    """A sparse index: block, first_key, rows, start (row number) and end (start of the next block) of a run, per `run`."""
    n = F.row_number().over(Window.partitionBy("run").orderBy("key")) - 1
    b = entries.withColumn("n", n).groupBy("run", F.floor(F.col("n") / block_rows).alias("block")).agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("rows"), F.min("n").cast("long").alias("start"))
    nxt = F.lead("start").over(Window.partitionBy("run").orderBy("block"))
    return b.withColumn("end", F.coalesce(nxt, F.col("start") + F.col("rows")))


def floor_block(index: DataFrame, key) -> DataFrame:
    """The block of each run that may hold the key: the last one whose first key is not greater."""
    return index.where(F.col("first_key") <= F.lit(key)).groupBy("run").agg(F.max(F.struct("first_key", "block")).alias("b")).select("run", "b.block", "b.first_key")


def order_violations(entries: DataFrame, by: str, place: str) -> DataFrame:
    """Entries whose key does not exceed the one before it in its run, with that key: what a run's writer refuses."""
    before = F.lag("key").over(Window.partitionBy(by).orderBy(place))
    return entries.withColumn("before", before).where(F.col("key") <= F.col("before"))


def newest_first(runs: DataFrame) -> DataFrame:
    """Runs (gen, seq) with their place in the order that a reader asks them: newest first, by tier."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("gen").orderBy(F.desc("seq"))))


class RunStore:
    """Runs of one table in a folder, with its manifest.

    value_type is the type of the value column. All state is in the folder: a reader sees the runs of
    the last manifest file that was published, and half-written runs are orphans that `clean` removes.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string", value_type: str = "string", fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.schema = f"key {key_type}, lsn long, tombstone boolean, value {value_type}"
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def run_path(self, gen: int, seq: int) -> str:
        return f"{self.path}/runs/gen={gen}/seq={seq}"

    def read(self, runs: bool = False) -> DataFrame:
        """All mutations of live runs, tombstones included; runs: with the gen and seq of each one's run."""
        schema = self.schema + ", gen int, seq long" * runs
        paths = [self.run_path(g, s) for g, s in self.manifest.live()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        return (reader.option("basePath", f"{self.path}/runs") if runs else reader).parquet(*paths)

    def _write(self, log: DataFrame, gen: int, seq: int) -> None:
        log.repartitionByRange("key").sortWithinPartitions("key").write.parquet(self.run_path(gen, seq))

    def flush(self, log: DataFrame, batch: str | None = None) -> int:
        """Reduce log to a tier-0 run and publish it; the run's number. A log without rows makes no run and gives -1.

        batch: a name that is published with the run. A batch that was published before makes no second run.
        """
        if batch is not None and batch in self.manifest.batches():
            return -1
        seq = self.manifest.next_seq()
        self._write(latest(log.select("key", "lsn", "tombstone", "value")), 0, seq)
        if self.spark.read.schema(self.schema).parquet(self.run_path(0, seq)).isEmpty():
            fs, Path = self.manifest.fs()
            fs.delete(Path(self.run_path(0, seq)), True)
            return -1
        self.manifest.commit(add=[(0, seq)], batch=batch)
        return seq

    def replace(self, log: DataFrame) -> int:
        """Publish log as the only run, all others out, in one manifest file; its number."""
        old, seq = self.manifest.live(), self.manifest.next_seq()
        self._write(latest(log.select("key", "lsn", "tombstone", "value")), 0, seq)
        self.manifest.commit(add=[(0, seq)], drop=old)
        return seq

    def compact(self) -> int:
        """Merge the lowest tier with `fanout` runs into the next one until no tier qualifies; the number of merges.

        Inputs leave and the output enters in one manifest file, so no crash lets a deleted key return.
        """
        done = 0
        while True:
            live = self.manifest.live()
            tiers: dict[int, list[tuple[int, int]]] = {}
            for g, s in live:
                tiers.setdefault(g, []).append((g, s))
            ready = [g for g, runs in tiers.items() if len(runs) >= self.fanout]
            if not ready:
                return done
            gen = min(ready)
            inputs = self.spark.read.schema(self.schema).parquet(*(self.run_path(g, s) for g, s in tiers[gen]))
            seq = self.manifest.next_seq()
            self._write(merge(inputs, drop_tombstones=all(g <= gen for g in tiers)), gen + 1, seq)
            self.manifest.commit(add=[(gen + 1, seq)], drop=tiers[gen])
            done += 1

    def recover(self, folder: str) -> int:
        """Replay all log files of a folder in their order into one tier-0 run, publish it, then delete the logs; the run's number, -1 without records.

        A crash before the last step leaves logs whose replay makes a second run of the same mutations, which
        reading by lsn counts once. The lsn is the log's number times 2^32 and the place in it.
        """
        from tidelog.sources import wal

        seq = self.flush(wal.mutations(wal.read(self.spark, folder), self.schema.rpartition("value ")[2]))
        fs, Path = self.manifest.fs()
        for s in fs.globStatus(Path(f"{folder.rstrip('/')}/wal-*.log")) or []:
            fs.delete(s.getPath(), False)
        return seq

    def clean(self, older_than: float = 3600.0) -> list[tuple[int, int]]:
        """Delete runs on disk that are not live and whose folder is `older_than` seconds old at least; what was deleted.

        Younger ones may be of a writer that has not published yet. The age must exceed the longest flush or merge.
        """
        live = set(self.manifest.live())
        fs, Path = self.manifest.fs()
        before = time.time() - older_than
        gone = [r for r in self.on_disk() if r not in live and fs.getFileStatus(Path(self.run_path(*r))).getModificationTime() / 1000 <= before]
        for g, s in gone:
            fs.delete(Path(self.run_path(g, s)), True)
        return gone

    def on_disk(self) -> list[tuple[int, int]]:
        fs, Path = self.manifest.fs()
        out = []
        for p in fs.globStatus(Path(f"{self.path}/runs/gen=*/seq=*")) or []:
            at = p.getPath()
            out.append((int(at.getParent().getName()[4:]), int(at.getName()[4:])))
        return sorted(out)

    def bytes_on_disk(self) -> int:
        fs, Path = self.manifest.fs()
        at = Path(f"{self.path}/runs")
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0
