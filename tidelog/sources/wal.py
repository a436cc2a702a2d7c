"""Write-ahead log files: a codec, a batch data source `tidelog_wal` and a decoder for binaryFile tables.

Frame: CRC-32 (4 bytes, big-endian) of all that follows, type (1 put, 2 delete), counted key, and for a
put a counted value. A replay ends silently at the first frame that is cut short, fails its CRC or has
another type; what comes after it in the same file is not read, other files are.
"""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidelog.functions import varint

PUT, DELETE = 1, 2
SCHEMA = "wal_seq long, record_no long, type tinyint, key binary, value binary"


def frame(kind: int, key: bytes, value: bytes | None = None) -> bytes:
    if kind not in (PUT, DELETE):
        raise ValueError("a record is a put or a delete")
    body = bytes([kind]) + varint.put_bytes(key) + (varint.put_bytes(value or b"") if kind == PUT else b"")
    return zlib.crc32(body).to_bytes(4, "big") + body


def replay(data: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(type, key, value) of the valid prefix of a log."""
    at = 0
    while at + 5 <= len(data):
        crc, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4]
        try:
            if kind not in (PUT, DELETE):
                return
            key, end = varint.get_bytes(data, at + 5)
            value = None
            if kind == PUT:
                value, end = varint.get_bytes(data, end)
        except ValueError:
            return
        if zlib.crc32(data[at + 4 : end]) != crc:
            return
        yield kind, key, value
        at = end


def log_seq(path: str) -> int:
    m = re.search(r"wal-(\d+)\.log$", path)
    return int(m[1]) if m else -1


def _batches(seq: int, records: Iterator[tuple[int, bytes, bytes | None]]) -> Iterator[pa.RecordBatch]:
    """Records of a log as batches of bounded length."""
    place = 0
    while rows := list(itertools.islice(records, 1 << 14)):
        kinds, keys, values = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([seq] * len(rows), pa.int64()), pa.array(range(place, place + len(rows)), pa.int64()), pa.array(kinds, pa.int8()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["wal_seq", "record_no", "type", "key", "value"])
        place += len(rows)


def decode(files: DataFrame) -> DataFrame:
    """Records of log files given as a binaryFile table (path, content): what any store that Spark reads may hold.

    A log is one row and below 2 GB; logs end at a flush, long before that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _batches(log_seq(path), replay(content.as_py() or b""))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def mutations(records: DataFrame, value_type: str = "string") -> DataFrame:
    """key, lsn, tombstone and value of replayed records: text keys and values, lsn by log and place in it."""
    return records.select(F.col("key").cast("string").alias("key"), (F.col("wal_seq") * (1 << 32) + F.col("record_no")).alias("lsn"), (F.col("type") == DELETE).alias("tombstone"), F.col("value").cast("string").cast(value_type).alias("value"))


def write(log: DataFrame, folder: str) -> list[str]:
    """Write a log (wal_seq, lsn, key, tombstone, value) as one file wal-<wal_seq>.log each, in order of lsn; the files' names.

    A log has one appender, so it is one task's. Each attempt writes a file of its own and renames it when
    it is whole: a task that runs twice, or dies, leaves no half log. Values are written as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        seq, out, names = None, None, []
        temporary = f"{root}/.attempt-{TaskContext.get().taskAttemptId()}"

        def close() -> None:
            if out is not None:
                out.close()
                files.move(temporary, f"{root}/wal-{seq}.log")
                names.append(f"wal-{seq}.log")

        for b in batches:
            for n, key, gone, value in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if n != seq:
                    close()
                    seq, out = n, files.open_output_stream(temporary, compression=None)
                out.write(frame(DELETE if gone else PUT, key, value))
        close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    d = log.select("wal_seq", F.col("key").cast("binary").alias("key"), "tombstone", F.col("value").cast("string").cast("binary").alias("value"), "lsn")
    d = d.repartition("wal_seq").sortWithinPartitions("wal_seq", "lsn").drop("lsn")
    return sorted(r[0] for r in d.mapInArrow(run, "file string").collect())  # a name a log


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all wal-*.log files of a folder; none for a folder without any."""
    from tidelog.session import ship

    ship(spark)
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", "wal-*.log").load(folder))


class WalFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WalReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [WalFile(p) for p in sorted((i.path for i in info if log_seq(i.path) >= 0), key=log_seq)] or [WalFile("")]

    def read(self, partition):
        if not partition.path:
            return
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with files.open_input_file(partition.path) as f:
            data = f.read()
        yield from _batches(log_seq(partition.path), replay(data))


@dataclass
class WrittenLogs(WriterCommitMessage):
    """What one task has written: temporary file and number of each log."""

    logs: list[tuple[str, int]]


class WalWriter(DataSourceWriter):
    """Writes rows of SCHEMA, sorted by wal_seq and record_no in their task, as log files that appear together when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator) -> WrittenLogs:
        files, root = self._files()
        files.create_dir(root, recursive=True)
        logs: list[tuple[str, int]] = []
        for seq, rows in itertools.groupby(iterator, key=lambda r: r["wal_seq"]):
            logs.append((f"{root}/.{uuid.uuid4().hex}.tmp", seq))
            with files.open_output_stream(logs[-1][0], compression=None) as out:
                for r in rows:
                    out.write(frame(r["type"], bytes(r["key"]), None if r["value"] is None else bytes(r["value"])))
        return WrittenLogs(logs)

    def commit(self, messages) -> None:
        files, root = self._files()
        logs = [x for m in messages if m is not None for x in m.logs]
        seqs = [seq for _, seq in logs]
        if len(set(seqs)) < len(seqs):
            self.abort(messages)
            raise ValueError("a log's records lie in several tasks or out of order: repartition by wal_seq and sort within")
        for temporary, seq in logs:
            files.move(temporary, f"{root}/wal-{seq}.log")

    def abort(self, messages) -> None:
        files, _ = self._files()
        for m in messages:
            for temporary, _ in m.logs if m is not None else ():
                files.delete_file(temporary)


class WalSource(DataSource):
    """spark.read.format("tidelog_wal").load(folder), df.write.format("tidelog_wal").mode("append").save(folder); register it with spark.dataSource.register(WalSource)."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WalReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WalWriter(self.options["path"])



def valid_prefix(records: DataFrame, by: str = "wal_seq", place: str = "record_no", ok: str = "crc_ok") -> DataFrame:
    """Decoded records before the first bad one of their log. Only bad records are gathered: one place a log."""
    bad = records.where(~F.col(ok)).groupBy(by).agg(F.min(place).alias("_bad"))
    return records.join(bad, by, "left").where(F.col("_bad").isNull() | (F.col(place) < F.col("_bad"))).drop("_bad")
