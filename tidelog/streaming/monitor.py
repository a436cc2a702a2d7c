"""What running streams report: progress as rows, metrics through a listener, and the first error of many."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch long, input_rows long, rows_per_second double, state_rows long"


def _row(p: dict) -> tuple:
    return (p.get("name") or p["id"], p["batchId"], p["numInputRows"], float(p.get("processedRowsPerSecond") or 0.0), sum(s["numRowsTotal"] for s in p.get("stateOperators", [])))


def progress(spark: SparkSession, query) -> DataFrame:
    """A row for each batch that a query still remembers (spark.sql.streaming.numRecentProgressUpdates of them)."""
    return spark.createDataFrame([_row(json.loads(p.json) if hasattr(p, "json") else p) for p in query.recentProgress], PROGRESS)


class StreamMetrics(StreamingQueryListener):
    """Totals by query, to be scraped at any time; add it with spark.streams.addListener. A total is a few numbers, however long a query runs."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}
        self.errors: dict[str, str] = {}

    def onQueryStarted(self, event):
        self.totals.setdefault(str(event.id), {"batches": 0, "input_rows": 0, "state_rows": 0})

    def onQueryProgress(self, event):
        p = json.loads(event.progress.json)
        t = self.totals.setdefault(str(p["id"]), {"batches": 0, "input_rows": 0, "state_rows": 0})
        t["batches"] += 1
        t["input_rows"] += p["numInputRows"]
        t["state_rows"] = _row(p)[4]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.errors.setdefault(str(event.id), event.exception)

    def text(self) -> str:
        """The totals as lines of `name{query="id"} value`."""
        return "".join(f'stream_{k}{{query="{q}"}} {v}\n' for q, t in sorted(self.totals.items()) for k, v in t.items())


class Latch:
    """Background queries as one: the first error of any stays, whatever comes later, and closing stops and waits for all."""

    def __init__(self, queries: Iterable = ()):
        self.queries, self._first = list(queries), None

    def add(self, query):
        self.queries.append(query)
        return query

    def error(self) -> Exception | None:
        for q in self.queries:
            if self._first is None:
                self._first = q.exception()
        return self._first

    def close(self) -> None:
        """Stop all queries; raise the first error there was."""
        self.error()
        for q in self.queries:
            q.stop()
        if (e := self.error()) is not None:
            raise e
