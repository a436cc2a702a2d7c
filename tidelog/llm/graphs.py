"""Embedding near-duplicates by robust-pruned flat graphs on overlapping cluster shards.

1. Equal vectors of a label become one node. A label of at most `WHOLE` nodes is one shard. Nodes of a
   larger one go to the `OVERLAP` nearest centres of a model that is fitted on a bounded sample, with as
   many centres as keep a shard within a few blocks; centres closer to each other than `APART` are thinned
   out, so a tight group is not scattered. A shard larger than `SHARD` is cut into blocks by hash.
2. A graph is built on each block: candidates pruned robustly, so that each node keeps neighbours in
   all directions, and back edges added. A node's adjacency lists from all its shards are united.
3. In every pair of blocks of a shard, the nodes of one search the graph of the other: a greedy beam
   from the medoids; one with any hit is then compared with the whole block. A hit counts if its
   cosine in double precision reaches the threshold, and pairs inside a connected set so found are
   checked too. Nodes that share several shards are counted in the
   first of them. A block answers with counts and a star for each connected set, not with pairs.
4. Stars of all blocks are joined into components.
5. Every run audits itself: the links of up to `AUDITED` nodes, drawn by a hash, are counted against all
   nodes, and a run that has less than `LEAST` of them is an error.

The sample bounds the centres: with more than about SAMPLE / PER_CENTRE * SHARD * 2 nodes of one label,
shards and the pairs of their blocks grow with the label, and `most` should grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import written
from tidelog.llm.components import components
from tidelog.llm.vectors import kmeans, matrix, sample, valid

SAMPLE = 20_000
PER_CENTRE = 16  # sampled nodes a centre, at least
OVERLAP = 4
APART = 0.8  # largest cosine of two centres
SHARD = 2048  # nodes of a block at most, in the mean of its hash
WHOLE = 16  # blocks of a label that is not sharded, at most
AUDITED = 256
LEAST = 0.9
DEGREE = 24
POOL = 64  # candidates that a node's neighbours are pruned from
BEAM = 48
STEP = 6  # expansions of a query in a round
ALPHA = 1.2
MEDOIDS = 8


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centres at most, none nearer to another than APART."""
    c = kmeans(x, k)
    c = c / np.maximum(np.sqrt((c * c).sum(1)), 1e-12)[:, None]
    kept: list[int] = []
    for i in range(len(c)):
        if all(c[i] @ c[j] <= APART for j in kept):
            kept.append(i)
    return c[kept]


def prune(x: np.ndarray, node: int, pool: np.ndarray) -> list[int]:
    """Robust pruning: the nearest candidate stays and rules out those that it is ALPHA times nearer to than the node is."""
    d = 1 - x[pool] @ x[node]
    order = np.argsort(d, kind="stable")
    pool, d = pool[order], d[order]
    near = 1 - x[pool] @ x[pool].T
    alive = np.ones(len(pool), bool)
    out: list[int] = []
    for i in range(len(pool)):
        if alive[i]:
            out.append(int(pool[i]))
            if len(out) == DEGREE:
                break
            alive &= ALPHA * near[i] > d
    return out


def build(x: np.ndarray) -> list[list[int]]:
    """Adjacency lists of a block: pruned pools of its nearest members, with back edges, pruned again where they overflow."""
    n = len(x)
    if n == 1:
        return [[]]
    m = min(POOL, n - 1)
    out: list[list[int]] = []
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        pools = np.argpartition(-s, m - 1, axis=1)[:, :m]
        out += [prune(x, a + i, p) for i, p in enumerate(pools)]
    back: list[set[int]] = [set(o) for o in out]
    for i, o in enumerate(out):
        for j in o:
            back[j].add(i)
    return [o if len(b) <= len(o) else (sorted(b) if len(b) <= 2 * DEGREE else prune(x, i, np.array(sorted(b)))) for i, (o, b) in enumerate(zip(out, back, strict=True))]


def medoids(x: np.ndarray) -> np.ndarray:
    """The member nearest to the mean, and others farthest from those before."""
    first = int(np.argmax(x @ x.mean(0)))
    out, best = [first], x @ x[first]
    while len(out) < min(MEDOIDS, len(x)):
        nxt = int(np.argmin(best))
        out.append(nxt)
        best = np.maximum(best, x @ x[nxt])
    return np.array(out)


def range_search(x: np.ndarray, adjacency: np.ndarray, q: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean queries x members: the members at `cosine` or more that the search meets.

    A greedy beam of BEAM members runs from the medoids until all of it is expanded; then a query with
    any hit is compared with all members, as hits need not be in range, or neighbours, of each other.
    All queries advance together, STEP expansions a round. The walk is in single precision with a little slack; hits are verified in double.
    adjacency: members x width, rows padded with the member itself.
    """
    n, all_q = len(x), np.arange(len(q))
    xs, qs = x.astype(np.float32), q.astype(np.float32)
    near = np.float32(cosine - 1e-4)
    visited, expanded, hits = (np.zeros((len(q), n), bool) for _ in range(3))
    start = medoids(x)
    ids = np.tile(start, (len(q), 1))
    score = qs @ xs[start].T
    visited[:, start] = True
    hits[:, start] = score >= near

    def meet(rows: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        expanded[rows[:, None], picks] = True
        to = adjacency[picks].reshape(len(rows), -1)
        s = np.einsum("qd,qwd->qw", qs[rows], xs[to])
        s[visited[rows[:, None], to]] = -np.inf
        visited[rows[:, None], to] = True
        r, c = np.nonzero(s >= near)
        hits[rows[r], to[r, c]] = True
        return to, s

    rows = all_q
    while len(rows):
        free = np.where(expanded[rows[:, None], ids[rows]], -np.inf, score[rows])
        more = (free > -np.inf).any(1)
        rows, free = rows[more], free[more]
        if not len(rows):
            break
        k = min(STEP, free.shape[1])
        at = np.argpartition(-free, k - 1, axis=1)[:, :k]
        to, s = meet(rows, np.take_along_axis(ids[rows], at, 1))
        both, scores = np.concatenate([ids[rows], to], 1), np.concatenate([score[rows], s], 1)
        keep = min(BEAM, both.shape[1])
        best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
        if ids.shape[1] < keep:
            wider = np.zeros((len(q), keep), ids.dtype)
            wider[:, : ids.shape[1]] = ids
            lower = np.full((len(q), keep), -np.inf, score.dtype)
            lower[:, : score.shape[1]] = score
            ids, score = wider, lower
        ids[rows[:, None], np.arange(keep)] = np.take_along_axis(both, best, 1)
        score[rows[:, None], np.arange(keep)] = np.take_along_axis(scores, best, 1)
    some = np.flatnonzero(hits.any(1))
    hits[some] = qs[some] @ xs.T >= near
    r, c = np.nonzero(hits)
    for a in range(0, len(r), 1 << 18):
        i, j = r[a : a + (1 << 18)], c[a : a + (1 << 18)]
        hits[i, j] = np.einsum("nd,nd->n", q[i], x[j]) >= cosine
    return hits


def _roots(found: np.ndarray, x: np.ndarray, asks: np.ndarray, base: np.ndarray, adjacency: np.ndarray, cosine: float) -> np.ndarray:
    """The least member number of each member's connected set, over hits and over the links of the graph that are in range themselves.

    found: queries x base; asks, base: their member numbers; adjacency: rows of numbers in base.
    """
    root = np.arange(len(x))
    hit = [(int(asks[i]), base[np.flatnonzero(found[i])]) for i in np.flatnonzero(found.any(1))]
    for a in range(0, len(base), 128):
        to = base[adjacency[a : a + 128]]
        near = np.einsum("nd,nwd->nw", x[base[a : a + 128]], x[to]) >= cosine
        hit += [(int(base[a + i]), to[i][near[i]]) for i in np.flatnonzero(near.sum(1) > (to == base[a : a + 128, None]).sum(1))]
    changed = True
    while changed:  # labels only fall, and each round carries the least one a link further at least
        changed = False
        for a, to in hit:
            low = min(root[a], root[to].min())
            if root[a] > low or (root[to] > low).any():
                root[a] = low
                root[to] = low
                changed = True
    return root


def _complete(found: np.ndarray, root: np.ndarray, x: np.ndarray, asks: np.ndarray, base: np.ndarray, cosine: float) -> None:
    """Check all pairs inside each connected set that the search has found, and add those that reach the cosine."""
    sizes = np.bincount(root)
    for r in np.flatnonzero(sizes > 2):
        a, b = np.flatnonzero(root[asks] == r), np.flatnonzero(root[base] == r)
        if len(a) and len(b):
            found[np.ix_(a, b)] = x[asks[a]] @ x[base[b]].T >= cosine


def nodes_of(vectors: DataFrame) -> DataFrame:
    """A written table with a row for each distinct vector of a label: node (a number), least (smallest vec_id), label, embedding, copies, width."""
    d = vectors.where(valid() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    d = d.groupBy("label", F.col("embedding").cast("array<double>").alias("embedding")).agg(F.min(F.col("vec_id").cast("long")).alias("least"), F.count(F.lit(1)).alias("copies"))
    return written(d.select(F.monotonically_increasing_id().alias("node"), "least", "label", "embedding", "copies", F.size("embedding").alias("width")), "graph-distinct")


def level(nodes: int) -> int:
    """How a label of so many nodes is sharded: 0 as a whole, else by 4^(1 + level) centres, which leaves a shard 2 to 8 blocks."""
    out = 0
    if nodes > WHOLE * SHARD:
        while 4 ** (1 + out) < OVERLAP * nodes / (8 * SHARD):
            out += 1
    return out


def links(nodes: DataFrame, cosine: float = 0.98, most: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(node, found: linked rows of other nodes) and stars (u, v) over nodes (node, label, embedding, copies, width)."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    steps = F.lit(0)
    top = level(sizes.agg(F.max("_n")).first()[0] or 0)
    for k in range(1, top + 1):  # a level from the size on at which level() gives it
        steps = F.when(F.col("_n") > max(WHOLE * SHARD, 4**k * 8 * SHARD // OVERLAP), k).otherwise(steps)
    sizes = sizes.select("label", steps.alias("level"))
    model: dict[tuple[int, int], np.ndarray] = {}
    for w, x in sample(nodes, most).items() if top else ():
        x = x / np.sqrt((x * x).sum(1))[:, None]
        for k in range(1, top + 1):
            model[w, k] = centres(x, int(np.clip(len(x) // PER_CENTRE, 1, 4 ** (1 + k))))
    sent = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards: list[list[int]] = [[0]] * b.num_rows
            kinds = np.stack([b.column(4).to_numpy(), b.column(5).to_numpy()], 1)
            for kind in np.unique(kinds, axis=0) if b.num_rows else ():
                c = sent.value.get(tuple(kind.tolist()))
                if c is not None:
                    rows = np.flatnonzero((kinds == kind).all(1))
                    x = _unit(matrix(b.column(2).take(pa.array(rows))))
                    for r, near in zip(rows.tolist(), np.sort(np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :OVERLAP], axis=1).tolist(), strict=True):
                        shards[r] = near
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(shards, pa.list_(pa.int32()))], ["node", "label", "embedding", "copies", "width", "shards"])

    placed = nodes.join(sizes, "label").select("node", F.col("label").cast("string").alias("label"), "embedding", "copies", "width", "level").mapInArrow(assign, "node long, label string, embedding array<double>, copies long, width int, shards array<int>")
    placed = written(placed, "graph-nodes")
    members = placed.withColumn("shard", F.explode("shards"))
    key = ["label", "width", "shard"]
    held = members.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("blocks"))
    members = members.join(held, key).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))

    def graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 4):
            ids = rows.column("node").to_numpy()
            x = _unit(matrix(rows.column("embedding").combine_chunks()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[a].tolist() for a in build(x)], pa.list_(pa.int64()))], ["node", "to"])

    blocks = [*key, "block"]
    built = members.select(*blocks, "node", "embedding").repartition(*blocks).sortWithinPartitions(*blocks, "node")
    built = built.mapInArrow(graph, "node long, to array<long>").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
    ready = members.join(written(built, "graph-edges"), "node")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    met = ready.select(*key, "block", "node", "embedding", "copies", "shards", "to", F.explode(pairs).alias("p")).select(*key, "p.i", "p.j", "block", "node", "embedding", "copies", "shards", "to")
    cells = [*key, "i", "j"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 5):
            ids, block = rows.column("node").to_numpy(), rows.column("block").to_numpy()
            i, j, shard = (rows.column(c)[0].as_py() for c in ("i", "j", "shard"))
            x = _unit(matrix(rows.column("embedding").combine_chunks()))
            shards = rows.column("shards").to_pylist()
            copies = rows.column("copies").to_numpy()
            base = np.flatnonzero(block == j)
            asks = np.flatnonzero(block == i)
            if not len(base) or not len(asks):
                continue
            at = {int(v): k for k, v in enumerate(ids[base])}
            to = [[at[t] for t in a if t in at] for a in (rows.column("to")[int(k)].as_py() for k in base)]
            wide = max(1, max(map(len, to)))
            adjacency = np.array([a + [k] * (wide - len(a)) for k, a in enumerate(to)])
            counts = np.zeros(len(ids), np.int64)
            seen = np.zeros((len(asks), len(base)), bool)
            for s in range(0, len(asks), 512):
                seen[s : s + 512] = range_search(x[base], adjacency, x[asks[s : s + 512]], cosine)
            root = _roots(seen, x, asks, base, adjacency, cosine)
            _complete(seen, root, x, asks, base, cosine)
            if i == j:
                seen |= seen.T
                np.fill_diagonal(seen, False)
            own = seen
            if shard:
                before = np.zeros((len(ids), shard), np.float32)
                for k, s in enumerate(shards):
                    before[k, [t for t in s if t < shard]] = 1
                own = seen & ~(before[asks] @ before[base].T > 0)  # not met in an earlier shard
            counts[asks] += own @ copies[base]
            if i != j:
                counts[base] += copies[asks] @ own
            moved = np.flatnonzero(root != np.arange(len(ids)))
            us, vs = ids[moved].tolist(), ids[root[moved]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array([None] * len(ids), pa.int64())], ["node", "found", "star"])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array([0] * len(us), pa.int64()), pa.array(vs, pa.int64())], ["node", "found", "star"])

    out = met.repartition(*cells).sortWithinPartitions(*cells, "node").mapInArrow(find, "node long, found long, star long")
    out = written(out, "graph-links")
    share = audit(nodes, out.groupBy("node").agg(F.sum("found").alias("found")), cosine)
    if share < LEAST:
        raise RuntimeError(f"the graphs have only {share:.3f} of the audited links")
    return out.groupBy("node").agg(F.sum("found").alias("found")), out.where("star is not null").select(F.col("node").alias("u"), F.col("star").alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal first `keys` columns, of batches that are sorted by them. Groups are blocks and so bounded."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        a = 0
        for z in range(1, len(ks) + 1):
            if z == len(ks) or ks[z] != ks[a]:
                if ks[a] != now and held:
                    yield pa.Table.from_batches(held)
                    held = []
                now = ks[a]
                held.append(b.slice(a, z - a))
                a = z
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Two rows link when their labels are equal and their cosine, in double precision, reaches `cosine`.
    A null label, and a vector that is null, empty, zero or holds null or non-finite components, links
    with nothing; neither do vectors of unequal length. Equal vectors of one label are linked whatever
    rounding makes of their cosine. A null vec_id keeps its row, links with nothing and is its own
    component (null). Rows that repeat an id are rows of their own: each counts as a link of the other
    if they qualify. A run that misses more than a tenth of the audited links is an error. An empty table gives an empty result. Other columns play no part.
    """
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    d = d.withColumn("_ok", F.coalesce(valid() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    nodes = nodes_of(d)
    found, stars = links(nodes, cosine)
    joined = nodes.select("node", "least").join(components(stars), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("_component"))
    known = nodes.join(found, "node", "left").join(joined.select("node", "component"), "node").join(least, "component")
    known = known.select("label", F.col("embedding").alias("_e"), (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("_links"), "_component")
    e = F.when(F.col("_ok"), F.col("embedding").cast("array<double>"))
    out = d.withColumn("_e", e).join(known, ["label", "_e"], "left")
    out = out.select("vec_id", F.coalesce(F.when(F.col("_ok"), F.col("_links")), F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_ok"), F.col("_component")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(nodes: DataFrame, found: DataFrame, cosine: float = 0.98, most: int = AUDITED) -> float:
    """Share of the true links of at most `most` nodes, each held against all nodes in blocks, that found (node, found) has; 1 without any."""
    columns = lambda d: d.select("node", "embedding", F.col("label").cast("string").alias("label"), "copies")
    asked = columns(nodes).orderBy(F.xxhash64("embedding", "label"), "node").limit(most).collect()
    by: dict[int, list] = {}
    for r in asked:
        by.setdefault(len(r[1]), []).append(r)
    sent = nodes.sparkSession.sparkContext.broadcast({w: (np.array([r[0] for r in rs]), np.array([r[2] for r in rs]), _unit(np.array([r[1] for r in rs], np.float64))) for w, rs in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            widths = pc.list_value_length(b.column(1)).to_numpy()
            for w, (ids, labels, q) in sent.value.items():
                rows = np.flatnonzero(widths == w)
                if len(rows):
                    part = b.take(pa.array(rows))
                    hit = (q @ _unit(matrix(part.column(1))).T >= cosine) & (labels[:, None] == np.array(part.column(2).to_pylist())[None, :]) & (ids[:, None] != part.column(0).to_numpy()[None, :])
                    for i, n in zip(ids.tolist(), (hit @ part.column(3).to_numpy()).tolist(), strict=True):
                        total[i] = total.get(i, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "true"])

    true = columns(nodes).mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    r = true.join(found, "node", "left").agg(F.sum(F.least("true", F.coalesce("found", F.lit(0)))), F.sum("true")).first()
    return r[0] / r[1] if r[1] else 1.0
