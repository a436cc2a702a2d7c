"""The live set of runs as a fold over an append-only log of ADD and DEL entries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def live_set(log: DataFrame, *key: str) -> DataFrame:
    """Keys whose last entry is ADD. log: pos, op and the key columns. Unknown verbs are ignored."""
    known = log.where(F.col("op").isin("ADD", "DEL"))
    return known.groupBy(*key).agg(F.max_by("op", "pos").alias("op")).where("op = 'ADD'").drop("op")


def orphans(on_disk: DataFrame, live: DataFrame, *key: str) -> DataFrame:
    """What is on disk and not live."""
    return on_disk.join(live, list(key), "left_anti")


def replace_subset(runs: DataFrame, inputs: DataFrame, output: DataFrame, *key: str) -> DataFrame:
    """runs without inputs and with output: what a merge publishes."""
    return runs.join(inputs, list(key), "left_anti").unionByName(output)


def parse_log(lines: DataFrame) -> DataFrame:
    """pos, op, gen, seq of manifest text (pos, line), up to the first malformed line of each file.

    A line is `ADD gen seq` or `DEL gen seq`. Lines with another verb and two numbers are kept out but
    end nothing. Column `file`, where there is one, keeps files apart.
    """
    by = ["file"] if "file" in lines.columns else []
    d = lines.withColumn("_m", F.col("line").rlike(r"^\S+ \d+ \d+$"))
    bad = F.min(F.when(~F.col("_m"), F.col("pos"))).over(Window.partitionBy(*by))
    d = d.withColumn("_bad", bad).where(F.col("_bad").isNull() | (F.col("pos") < F.col("_bad")))
    part = F.split("line", " ")
    d = d.select(*by, "pos", part[0].alias("op"), part[1].cast("int").alias("gen"), part[2].cast("long").alias("seq"))
    return d.where(F.col("op").isin("ADD", "DEL"))


class Manifest:
    """Numbered text files of `ADD gen seq` and `DEL gen seq` lines; a commit is one new file, renamed into place.

    A file is read whole or not at all, so a commit is atomic. A malformed line is an error unless it
    is the last one of the last file: a silently shortened manifest would make live runs look orphaned.
    """

    NAME = re.compile(r"^\d{12}\.(?:log|snap)$")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fs(self):
        jvm = self.spark.sparkContext._jvm
        Path = jvm.org.apache.hadoop.fs.Path
        return Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), Path

    def files(self) -> list[str]:
        """The newest snapshot, if any, and the files after it, in order."""
        fs, Path = self.fs()
        if not fs.exists(Path(self.path)):
            return []
        names = sorted(n for s in fs.listStatus(Path(self.path)) if self.NAME.match(n := s.getPath().getName()))
        last = max((n for n in names if n.endswith(".snap")), default="")
        return ([last] if last else []) + [n for n in names if n.endswith(".log") and n[:12] > last[:12]]

    def snapshot(self) -> None:
        """Restate what all files say in one, named after the last of them, then delete those before it.

        Live runs, the largest number ever used, and the last batch of each stream are kept. Readers that
        list the folder before or after see the same; so does one that fails and lists it again. One writer
        at a time, as with commits.
        """
        files = self.files()
        if not any(f.endswith(".log") for f in files):
            return
        live, top = self.live(), self.next_seq() - 1
        last: dict[str, str] = {}
        for b in sorted(self.batches(), key=lambda b: (len(b), b)):
            last[b.rpartition("#")[0] or b] = b
        body = "".join(f"ADD {g} {s}\n" for g, s in sorted(live)) + (f"DEL 0 {top}\n" if top and top not in {s for _, s in live} else "") + "".join(f"BATCH {b}\n" for b in last.values())
        fs, Path = self.fs()
        self._put(f"{files[-1][:12]}.snap", body)
        for f in files:
            fs.delete(Path(f"{self.path}/{f}"), False)

    def _put(self, name: str, body: str) -> None:
        fs, Path = self.fs()
        target, temporary = f"{self.path}/{name}", f"{self.path}/.{name}.tmp"
        stream = fs.create(Path(temporary), True)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        if fs.exists(Path(target)) or not fs.rename(Path(temporary), Path(target)):
            raise RuntimeError(f"{target} was published by another writer")

    def lines(self) -> list[str]:
        """All lines of all files, in order. A malformed line is an error unless it is the last of the last file."""
        fs, Path = self.fs()
        jvm = self.spark.sparkContext._jvm
        out = []
        files = self.files()
        for f in files:
            stream = fs.open(Path(f"{self.path}/{f}"))
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            lines = text.split("\n")
            for k, line in enumerate(lines):
                if re.fullmatch(r"\S+ \d+ \d+|BATCH \S+", line):
                    out.append(line)
                elif line and not (f == files[-1] and k == len(lines) - 1):
                    raise ValueError(f"malformed manifest line in {f}: {line!r}")
        return out

    def entries(self) -> list[tuple[str, int, int]]:
        found = (re.fullmatch(r"(ADD|DEL) (\d+) (\d+)", line) for line in self.lines())
        return [(m[1], int(m[2]), int(m[3])) for m in found if m]

    def live(self) -> list[tuple[int, int]]:
        """(gen, seq) of live runs, newest first."""
        found: dict[tuple[int, int], bool] = {}
        for op, g, s in self.entries():
            found[g, s] = op == "ADD"
        return sorted((r for r, on in found.items() if on), key=lambda r: -r[1])

    def next_seq(self) -> int:
        return max((s for _, _, s in self.entries()), default=0) + 1

    def batches(self) -> set[str]:
        """Names of the batches whose runs were published."""
        return {m[1] for line in self.lines() if (m := re.fullmatch(r"BATCH (\S+)", line))}

    def commit(self, add: list[tuple[int, int]] = (), drop: list[tuple[int, int]] = (), batch: str | None = None) -> None:
        """Publish additions, removals and a batch's name together. A file of the same number, from another writer, makes this fail."""
        files = self.files()
        number = int(files[-1][:12]) + 1 if files else 1
        self._put(f"{number:012d}.log", "".join(f"ADD {g} {s}\n" for g, s in add) + "".join(f"DEL {g} {s}\n" for g, s in drop) + (f"BATCH {batch}\n" if batch is not None else ""))
