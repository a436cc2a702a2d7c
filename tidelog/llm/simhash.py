"""SimHash near-duplicates by the generalised pigeonhole principle (after Qin et al., 2018).

The 64 bits are cut into parts, correlated bits together, and part g gets a threshold t(g) >= -1 with
the sum of t(g) + 1 equal to 4. Two fingerprints at 3 or fewer differing bits then differ in at most
t(g) bits of some part, so probing each part's values within its threshold misses no link. Sizes and
thresholds come from a dynamic programme over estimated costs; they change the work, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import spread, written
from tidelog.llm.components import components

BITS = 64
SAMPLE = 2048  # fingerprints that costs are estimated from
ROWS = 128  # fingerprints of the sample compared with all others at once
BUCKET = 4096  # most fingerprints of a bucket in one block; larger buckets are met block by block


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text, repeats included; 0 without words.

    bytes.lower and bytes.split know only A-Z and the six ASCII white-space characters. A bit is set
    if it is in more than half of the shingles' XXH64.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    cuts = zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)
    counts = np.zeros(BITS, np.int64)
    block: list[int] = []
    for a, b in cuts:
        block.append(h(line[a : b - 1], seed))
        if len(block) == 65536:
            counts += _bit_counts(block)
            block = []
    if block:
        counts += _bit_counts(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, mark (a hash that tells its texts apart) and the fingerprint as a signed long. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py() or b"", shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "mark", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))).mapInArrow(run, "doc_id long, mark long, fp long")


def correlated_parts(bits: np.ndarray, m: int) -> list[list[int]]:
    """Cut the columns of a 0/1 sample into m parts of nearly equal size, each grown from the bits most correlated with it."""
    c = bits - bits.mean(0)
    norm = np.sqrt((c * c).sum(0))
    r = np.abs(c.T @ c) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(r, 0)
    left, parts = list(range(bits.shape[1])), []
    for g in range(m):
        size = -(-len(left) // (m - g))
        part = [max(left, key=lambda i: (r[i, left].max(), -i))]
        left.remove(part[0])
        while len(part) < size:
            nxt = max(left, key=lambda i: (r[i, part].sum(), -i))
            part.append(nxt)
            left.remove(nxt)
        parts.append(sorted(part))
    return parts


def allocate(cost: list[list[float]], distance: int) -> list[int]:
    """Thresholds t(g) in -1..distance with sum of t(g) + 1 = distance + 1 at the least total cost; cost[g][t], and -1 is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in best.items():
            for t in range(-1, distance - used + 1):
                x = total + (row[t] if t >= 0 else 0.0)
                if used + t + 1 not in new or x < new[used + t + 1][0]:
                    new[used + t + 1] = (x, [*ts, t])
        best = new
    return best[distance + 1][1]


def _met(sample: np.ndarray, mask: np.uint64, distance: int) -> list[int]:
    """For each t up to distance, the ordered pairs of a sample that differ in at most t bits of mask, but in more than distance bits of all: links are met under any plan.

    The pairs are looked at ROWS rows at a time, as the driver has little memory.
    """
    n = np.zeros(distance + 1, np.int64)
    for a in range(0, len(sample), ROWS):
        x = sample[a : a + ROWS, None] ^ sample[None, :]
        far = np.bitwise_count(x) > distance
        np.bitwise_and(x, mask, out=x)
        d = np.bitwise_count(x)
        n += [np.count_nonzero((d <= t) & far) for t in range(distance + 1)]
    return n.tolist()


def plan(sample: np.ndarray, n: int, distance: int = 3, probe: float = 1.0, verify: float = 0.02) -> list[tuple[list[int], int]]:
    """Parts (bit numbers) with their thresholds for n fingerprints, from a sample of them (uint64).

    A part's cost is the rows its probes make, at `probe` each, and the pairs expected to share a value
    within the threshold, at `verify` each: the sample's share of such pairs that are no links, or that
    of even bits if larger.
    """
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    best = (float("inf"), [])
    for m in range(1, 17):
        parts = correlated_parts(bits.astype(float), m) if len(sample) > 1 else [list(range(g, BITS, m)) for g in range(m)]
        cost = []
        for p in parts:
            mask = np.uint64(sum(1 << i for i in p))
            met = _met(sample, mask, distance)
            pairs = max(1, len(sample) * (len(sample) - 1))
            row = []
            for t in range(distance + 1):
                ball = sum(comb(len(p), k) for k in range(t + 1))
                share = max(met[t] / pairs, ball / 2.0 ** len(p))
                row.append(n * ball * probe + n * n / 2 * share * verify)
            cost.append(row)
        ts = allocate(cost, distance)
        total = sum(cost[g][t] for g, t in enumerate(ts) if t >= 0)
        if total < best[0]:
            best = (total, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, value, fp: a row for each part and each value within its threshold; home marks a fingerprint's own value."""
    rows = []
    for g, (bits, t) in enumerate(parts):
        flips = [_signed(sum(1 << i for i in c)) for k in range(t + 1) for c in combinations(bits, k)]
        mask = _signed(sum(1 << i for i in bits))
        own = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
        rows.append(F.array(*(F.struct(F.lit(g).alias("part"), own.bitwiseXOR(F.lit(x).cast("long")).alias("value"), F.lit(x == 0).alias("home")) for x in flips)))
    return fps.select("fp", F.explode(F.concat(*rows)).alias("b")).select("b.part", "b.value", "b.home", "fp")


def _stars(fp: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of each fingerprint of a block to the first one of its connected set in the block.

    Each fingerprint is compared once with those not yet reached, so a set of near copies costs no
    step for each of its pairs.
    """
    left = np.arange(len(fp))
    us, vs = [], []
    while len(left):
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            near = np.bitwise_count(fp[left] ^ fp[front.pop()]) <= distance
            got = left[near]
            if len(got):
                left = left[~near]
                front.extend(got)
                us.append(got)
                vs.append(np.full(len(got), first))
    s = fp.view(np.int64)
    if not us:
        return [], []
    return s[np.concatenate(us)].tolist(), s[np.concatenate(vs)].tolist()


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """u, v: links at `distance` or fewer bits that connect just what all such links of fps (distinct fp) connect.

    A bucket gives a star for each connected set, so a group of near copies costs a row a member, not
    a row a pair. Buckets of more than BUCKET rows are cut into blocks by hash, and each pair of blocks
    is met in a task of its own.
    """
    spark = fps.sparkSession
    sample = [r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    n = max(fps.count(), 1)
    rows = buckets(fps, plan(np.array(sample, np.int64).view(np.uint64), n, distance))
    held = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("held"), F.max("home").alias("any"))
    held = held.where("held > 1 and any").select("part", "value", F.ceil(F.col("held") / BUCKET).cast("int").alias("blocks"))
    rows = rows.join(held, ["part", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = rows.select("part", "value", "fp", F.explode(met).alias("m")).select("part", "value", "m.i", "m.j", "fp")
    keys = ["part", "value", "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            us, vs = [], []

            def close(fp: list[int], us: list[int] = us, vs: list[int] = vs) -> None:
                if len(fp) < 2:
                    return
                if len(fp) == 2:
                    if ((fp[0] ^ fp[1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance:
                        us.append(max(fp))
                        vs.append(min(fp))
                    return
                u, v = _stars(np.array(fp, np.int64).view(np.uint64), distance)
                us.extend(u)
                vs.extend(v)

            *key, fp = (b.column(i).to_pylist() for i in range(5))
            for k, x in zip(zip(*key, strict=True), fp, strict=True):
                if k != now:
                    close(held)
                    now, held = k, []
                held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
        us, vs = [], []
        if len(held) > 1:
            us, vs = _stars(np.array(held, np.int64).view(np.uint64), distance)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, mark, fp (signed), fingerprint (16 hex digits) and component_id of every document.

    Documents with one fingerprint are one node; component_id is the smallest doc_id that links reach.
    Null or wordless text has fingerprint zero and links like any other. A null doc_id keeps its row
    but is nobody's component_id unless no other id is in reach. Repeated rows stay and share a component; an id
    with two texts links nothing by itself. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, shingle), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select("fp"), distance))
    nodes = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = nodes.join(least, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "mark", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
