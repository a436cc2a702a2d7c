"""Streams of mutations: keyed last-writer-wins state, micro-batch flush and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.runs import RunStore


def lww_stream(log: DataFrame) -> DataFrame:
    """The state of each key after every batch that touches it: key, lsn, tombstone, value. Write it in update mode.

    log: key, lsn, tombstone, value. A mutation below the state's lsn is late or a replay and changes
    nothing, so shuffled and repeated input settles on the batch answer. All of it runs in the JVM.
    """
    newest = F.max_by(F.struct("lsn", "tombstone", "value"), F.struct("lsn", "tombstone"))
    return log.groupBy("key").agg(newest.alias("m")).select("key", "m.lsn", "m.tombstone", "m.value")


def to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """A writer of each micro-batch's rows to path/batch=<id>. A batch that runs again replaces its folder, so each counts once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)


def flush_batches(log: DataFrame, store: RunStore, checkpoint: str):
    """A writer that makes each micro-batch a run and then lets compaction run: group commit by batch.

    The manifest names the batch with its run, so a batch that is replayed after a failure makes no second one.
    Batches must come in order of lsn, as those of one log do: a merge drops deletes that nothing older needs,
    and a mutation from before such a delete, arriving after it, would bring its key back.
    """

    def publish(batch: DataFrame, number: int) -> None:
        store.flush(batch, batch=f"{checkpoint}#{number}")
        store.compact()

    return log.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


def without_retries(requests: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Requests whose request_id came before, within the watermark, count once."""
    return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["request_id"])


def windowed_totals(requests: DataFrame, width: str = "1 hour", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Requests by time window, op and result."""
    return requests.withWatermark(ts, delay).groupBy(F.window(ts, width), "op", "result").agg(F.count(F.lit(1)).alias("requests"))
