"""Nearest neighbours by inner product: an inverted file with product-quantised residuals and exact reranking.

Coarse centres and codebooks are fitted on at most `SAMPLE` vectors. Every row is indexed: its list,
the codes of its residual and the vector itself. A query probes the lists whose centres suit it best,
ranks a list's codes by its table of partial products, reranks the best of each block on the original
vectors, and then every row whose rough product, with `SLACK` standard errors of its quantisation
added, passes the k-th best so far; a window keeps its k best. How many lists a query probes is measured on the sample: as
many as hold `COVER` of the true neighbours there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import written
from tidelog.llm.vectors import kmeans, matrix, nearest, sample, valid

SAMPLE = 20_000
FEWEST = 4  # sampled vectors to a list at least
COVER = 0.99
BLOCK = 4096  # rows of a list that one task holds at a time
DEPTH = 96  # rows of a block that are reranked for a query
SLACK = 4.0
ASKS = 1 << 16  # queries of a list that meet a block in one task
HELD = 20_000  # queries whose best rows a task holds


@dataclass
class Index:
    centres: np.ndarray  # lists x d
    books: np.ndarray  # parts x 256 x d / parts
    probes: int
    fitted: bool = True  # without a sample there is one list, which is reranked whole

    @property
    def parts(self) -> int:
        return len(self.books)

    def split(self, x: np.ndarray) -> np.ndarray:
        """x as n x parts x width, padded with zeros."""
        width = self.books.shape[2]
        full = np.zeros((len(x), self.parts * width))
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), self.parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.centres)
        r = self.split(x - self.centres[at])
        return at, np.stack([nearest(r[:, m], self.books[m]) for m in range(self.parts)], 1).astype(np.uint8)


def fit(x: np.ndarray, n: int, parts: int = 16, k: int = 20, seed: int = 0) -> Index:
    """An index for n rows from a sample of them."""
    lists = int(np.clip(np.sqrt(n) / 2, 1, max(1, len(x) // FEWEST)))
    centres = kmeans(x, lists, seed=seed)
    width = -(-x.shape[1] // parts)
    ix = Index(centres, np.zeros((-(-x.shape[1] // width), 1, width)), 1)
    r = ix.split(x - centres[nearest(x, centres)])
    books = [kmeans(r[:, m], 256, seed=seed) for m in range(ix.parts)]
    ix.books = np.stack([np.concatenate([b, np.repeat(b[:1], 256 - len(b), 0)]) for b in books])
    home = nearest(x, centres)
    q = x[np.random.default_rng(seed).choice(len(x), min(256, len(x)), replace=False)]
    top = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k + 1]
    rank = np.empty((len(q), len(centres)), np.int64)
    np.put_along_axis(rank, np.argsort(-(q @ centres.T), axis=1, kind="stable"), np.arange(len(centres))[None, :], 1)
    found = np.take_along_axis(rank, home[top], 1).ravel()
    ix.probes = int(np.quantile(found, COVER, method="higher")) + 1
    return ix


class Indexes:
    """An index for each length of vectors that the sample holds; any other length has one list."""

    def __init__(self, by_length: dict[int, Index]):
        self.by_length = by_length

    def of(self, length: int) -> Index:
        return self.by_length.get(length) or Index(np.zeros((1, length)), np.zeros((1, 256, length)), 1, False)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length in a list column."""
    lengths = pc.list_value_length(column).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, matrix(column if len(at) == len(column) else column.take(pa.array(at)))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    if len(scores) > k:
        keep = scores >= -np.partition(-scores, k - 1)[k - 1]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(base: DataFrame, queries: DataFrame, k: int = 20, most: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: for each query (vec_id, embedding) its k nearest of base, not counting rows with its own id.

    score is the inner product in double precision. Equal scores go to the smaller vec_id. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without an id, take no part;
    a repeated id can appear once for each row with other components, and once for equal rows. Query rows
    that are equal are one query; those that share an id but not the vector are answered each, under that
    id. Vectors of another length are no candidates. Fewer than k candidates give fewer rows; an empty
    base or query table gives none. Other columns play no part, whatever their names.
    """
    spark = base.sparkSession
    rows_of = lambda d: d.where(valid() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept, asked = rows_of(base), rows_of(queries).distinct()
    drawn = sample(kept, most)
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, taken = kept.count(), sum(map(len, drawn.values()))
    ix = spark.sparkContext.broadcast(Indexes({w: fit(x, total * len(x) // taken, k=k) for w, x in drawn.items()}))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in by_length(b.column(1)):
                at, codes = ix.value.of(x.shape[1]).encode(x)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(at.astype(np.int32)), part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["width", "list", "vec_id", "embedding", "codes"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                for rows, x in by_length((cut := b.slice(s, 1024)).column(1)):
                    index = ix.value.of(x.shape[1])
                    lists = np.argsort(-(x @ index.centres.T), axis=1, kind="stable")[:, : index.probes]
                    part = cut.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), part.column(0), part.column(1), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], ["width", "vec_id", "embedding", "lists"])

    rows = written(kept.mapInArrow(code, "width int, list int, vec_id long, embedding array<double>, codes binary"), "ivf")
    probes = asked.mapInArrow(probe, "width int, vec_id long, embedding array<double>, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")
    key = ["width", "list"]
    held = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asks = probes.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("parts"))
    cells = written(held.join(asks, key), "ivf-cells")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = rows.join(cells, key).withColumn("part", each("parts"))
    data = data.select(*key, F.pmod(F.xxhash64("vec_id", "embedding"), "blocks").cast("int").alias("block"), "part", F.lit(0).alias("asks"), "vec_id", "embedding", "codes")
    probes = probes.join(cells, key).withColumn("block", each("blocks"))
    probes = probes.select(*key, "block", F.pmod(F.xxhash64("vec_id", "embedding"), "parts").cast("int").alias("part"), F.lit(1).alias("asks"), "vec_id", "embedding", F.lit(None).cast("binary").alias("codes"))
    cell = [*key, "block", "part"]
    met = data.union(probes).repartition(*cell).sortWithinPartitions(*cell, "asks", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray]] = {}  # by id and vector
        now, ids, vecs, codes = None, [], [], []

        def out() -> pa.RecordBatch:
            n = [len(s) for s, _ in best.values()]
            q = np.repeat(np.array([i for i, _ in best], np.int64), n)
            # digests tell the vectors of a repeated id apart
            asks = np.repeat(np.array([int.from_bytes(hashlib.blake2b(v, digest_size=8).digest(), "little", signed=True) for _, v in best], np.int64), n)
            s = np.concatenate([s for s, _ in best.values()])
            v = np.concatenate([v for _, v in best.values()])
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(asks), pa.array(v), pa.array(s)], ["query_id", "ask", "vec_id", "score"])

        def answer(at: int, qs: np.ndarray, q: np.ndarray) -> None:
            index = ix.value.of(q.shape[1])
            i, v = np.concatenate(ids), np.concatenate(vecs)
            c = np.frombuffer(b"".join(codes), np.uint8).reshape(len(i), -1)
            both = np.unique(np.concatenate([i[:, None].astype(np.float64), v], 1), axis=0, return_index=True)[1]  # equal rows once
            i, v, c = i[both], v[both], c[both]
            _, first, group = np.unique(v, axis=0, return_index=True, return_inverse=True)  # copies are ranked as one
            group = group.reshape(-1)
            order = np.lexsort((i, group))
            start = np.searchsorted(group[order], np.arange(len(first) + 1))
            tables = np.einsum("qpw,pcw->qpc", index.split(q), index.books)
            rough = np.repeat((q @ index.centres[at])[:, None], len(first), 1)
            for p in range(index.parts):
                rough += tables[:, p][:, c[first, p]]
            exact_rows = v[first]
            depth = min(DEPTH, len(first))
            near = np.argpartition(-rough, depth - 1, axis=1)[:, :depth]
            scores = np.einsum("qd,qnd->qn", q, exact_rows[near])
            read = index.centres[at] + np.concatenate([index.books[p][c[first, p]] for p in range(index.parts)], 1)[:, : q.shape[1]]
            error = np.sqrt(((exact_rows - read) ** 2).sum(1) / q.shape[1])
            slack = SLACK * np.sqrt((q * q).sum(1))

            def add(ask: tuple[int, bytes], s: np.ndarray, g: np.ndarray) -> None:
                if len(s) > k + 1:
                    keep = s >= -np.partition(-s, k)[k]
                    s, g = s[keep], g[keep]
                take = [order[start[j] : start[j + 1]][: k + 1] for j in g]
                cand = i[np.concatenate(take)]
                val = np.repeat(s, [len(t) for t in take])
                own = cand != ask[0]
                cand, val = cand[own], val[own]
                if ask in best:
                    val, cand = np.concatenate([best[ask][0], val]), np.concatenate([best[ask][1], cand])
                best[ask] = _best(val, cand, k)

            for r, ask in enumerate(zip(qs.tolist(), map(bytes, q), strict=True)):
                add(ask, scores[r], near[r])
                if depth < len(first):
                    s = best[ask][0]
                    more = rough[r] + slack[r] * error > (s[-1] if len(s) >= k else -np.inf) if index.fitted else np.ones(len(first), bool)
                    more[near[r]] = False
                    more = np.flatnonzero(more)
                    if len(more):
                        add(ask, exact_rows[more] @ q[r], more)

        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(j).to_numpy() for j in range(5)], 1)
            vec_ids = b.column(5).to_numpy()
            cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                cell = tuple(place[a, :4].tolist())
                m = matrix(b.column(6).slice(a, z - a))
                if cell != now:
                    now, ids, vecs, codes = cell, [], [], []
                if not place[a, 4]:
                    ids.append(vec_ids[a:z])
                    vecs.append(m)
                    codes += b.column(7).slice(a, z - a).to_pylist()
                elif ids:
                    for s in range(0, z - a, 256):
                        answer(cell[1], vec_ids[a + s : a + min(s + 256, z - a)], m[s : s + 256])
                    if len(best) > HELD:
                        yield out()
        if best:
            yield out()

    found = met.mapInArrow(run, "query_id long, ask long, vec_id long, score double")
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, base: DataFrame, queries: DataFrame, k: int = 20, most: int = 256) -> float:
    """Share of the true k nearest that found has, over at most `most` of the queries, each held against all of base in blocks. For vectors of one length and unique ids."""
    asked = queries.where(valid()).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id")).limit(most).collect()
    if not asked:
        return 1.0
    ids, q = np.array([r[0] for r in asked]), np.array([r[1] for r in asked], np.float64)
    sent = base.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for b in batches:
            if b.num_rows:
                v, s = b.column(0).to_numpy(), q @ matrix(b.column(1)).T
                rows = [(i, *_best(x[v != i], v[v != i], k)) for i, x in zip(ids.tolist(), s, strict=True)]
                n = [len(s) for _, s, _ in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([v for _, _, v in rows])), pa.array(np.concatenate([s for _, s, _ in rows]))], ["query_id", "vec_id", "score"])

    true = base.where(valid()).select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = true.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    r = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")).first()
    return (r["hits"] or 0) / r["n"] if r["n"] else 1.0
