"""WARC archives read through an index.

`write` makes one WARC/1.1 record per page, each its own gzip member, in archives of bounded size in
the shared folder, and returns the index: file, offset, length, url and digest of every record.
`read` takes any selection of that index, sorts it by place, merges neighbouring byte ranges into one
read each, and parses the records.

A task names its archives after its attempt, and the index holds only what committed tasks report: a
task that runs twice leaves an archive that no index row points to, never a wrong row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import scratch, written

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
TASK_BYTES = 64 << 20  # compressed bytes that a task reads in the mean
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """A header line can't hold line ends; they are percent-encoded as the target's other octets are."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str | None] | None, place: str, date: str) -> tuple[bytes, str]:
    """One record as a gzip member, and its payload's digest. A revisit keeps the HTTP header, not the payload.

    refers_to: id and url of the response that a revisit refers to. place: what makes the record's id its
    own, as rows may repeat. date: when the archive was written, which is all that is known of a page.
    """
    sha = digest(payload)
    revisit = refers_to is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {refers_to[0]}"]
        if refers_to[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_to[1])}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0), sha


def parse(raw: bytes) -> dict:
    """The record in an uncompressed gzip member. A revisit's payload is null; its length and digest are the full payload's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload_digest": sha, "payload_bytes": size, "payload": payload if kind == "response" else None}


def first_of_equals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, and page_id and url of the response of each row that revisits one; no payload is shuffled.

    Sums in the map tasks come first, so a payload that a third of the pages share costs a row a task;
    adaptive execution can split the join that follows, which carries ids and digests only.
    """
    p = F.coalesce(F.col("html"), F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(p.cast("binary")).alias("_sha"), F.octet_length(p).cast("long").alias("_size")).where(F.col("_size") >= min_bytes)
    first = d.groupBy("_sha").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    later = d.join(first, "_sha").where(~F.col("page_id").eqNullSafe(F.col("_first.page_id")))
    return later.groupBy("page_id", "_sha").agg(F.first("_first").alias("_first"))


def write(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 256 << 20, at: str | None = None, date: str | None = None) -> DataFrame:
    """Archive pages (page_id, url, html) and return the index, a written table.

    Of rows with equal payloads of at least min_bytes, those with the smallest page_id are responses
    and the others revisit it. Null html is the empty payload. A null page_id counts as the largest;
    if all ids of a payload are null, each row is a response. Rows that repeat the smallest page_id
    are all responses, each a record of its own. A null url is left out of its record; line ends in a url
    are percent-encoded. Payloads of any length are one record. An empty table makes no archive. Other
    columns play no part. date: of the records, the time of this call if none is given.

    Pages meet their marks by page_id and digest, so a payload that many share is spread over all tasks;
    few marks are broadcast by Spark's own measure, and pages then lie where they were read.
    """
    spark = pages.sparkSession
    at = at or scratch(spark, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    p = F.coalesce(F.col("html"), F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", p.cast("binary").alias("_payload")).withColumn("_sha", F.sha1("_payload"))
    marks = first_of_equals(pages, min_bytes)
    d = d.join(marks.select(F.col("page_id").alias("_id"), F.col("_sha").alias("_mark"), "_first"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_mark")), "left")
    d = d.select("page_id", "url", "_payload", F.col("_first.page_id").alias("_first"), F.col("_first.url").alias("_url"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(at)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, place, number, records = None, 0, 0, 0
        for b in batches:
            rows = []
            for page_id, url, payload, first, first_url in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                records += 1
                member, sha = record(page_id, url, payload, None if first is None else (first, first_url), f"{at}/{task.taskAttemptId()}/{records}", date)
                if out is None or place + len(member) > archive_bytes and place:
                    if out is not None:
                        out.close()
                    name = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, place, number = files.open_output_stream(name, compression=None), 0, number + 1
                out.write(member)
                rows.append((page_id, _uri(url) if url is not None else None, "response" if first is None else "revisit", first, sha, len(payload), name.rpartition("/")[2], place, len(member)))
                place += len(member)
            if rows:
                yield _batch(rows, INDEX)
        if out is not None:
            out.close()

    return written(d.mapInArrow(archive, INDEX).withColumn("file", F.concat(F.lit(at.rstrip("/") + "/"), "file")), "warc-index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def ranges(places: Iterable[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Merge sorted (file, offset, length) into reads: file, end and the (offset, length) pairs inside.

    A record joins the read before it if at most `gap` unwanted bytes lie between and the read stays
    within `most` bytes; a longer record is a read of its own.
    """
    now, end, inside = "", 0, []
    for file, offset, length in places:
        if inside and file == now and offset - end <= gap and offset + length - inside[0][0] <= most:
            inside.append((offset, length))
            end = max(end, offset + length)
            continue
        if inside:
            yield now, end, inside
        now, end, inside = file, offset + length, [(offset, length)]
    if inside:
        yield now, end, inside


def read(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that the index rows (file, offset, length, more) point to, by coalesced byte ranges.

    Rows are dealt by place, so a task's ranges lie side by side. The number of tasks follows the bytes that
    the rows point to, not the size of the index: TASK_BYTES a task at most in the mean, and as many tasks
    as run at once while each has a megabyte. A selected record that is damaged is an error, never a
    missing row; an empty selection gives no records.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-total // (1 << 20))), 1)
    d = index.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        places = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        name, source = "", None
        for file, end, inside in ranges(places, gap, most):
            if file != name:
                if source is not None:
                    source.close()
                files, path = fs.FileSystem.from_uri(file)
                name, source = file, files.open_input_file(path)
            start = inside[0][0]
            span = source.read_at(end - start, start)
            found = [parse(zlib.decompress(span[o - start : o - start + n], 31)) for o, n in inside]
            yield _batch([tuple(r.values()) for r in found], RECORD)
        if source is not None:
            source.close()

    return d.mapInArrow(fetch, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Every page through an archive and back: what the records say, without payloads."""
    return read(write(pages)).drop("payload")
