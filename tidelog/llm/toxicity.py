"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

1. At most `LABELLED` labelled rows, drawn by a hash of the id, are the examples; equal texts are one
   example with the mean of their labels. A text's vector has all its words: those of the examples by
   name, any other by one of `OTHER` hash buckets. Document frequencies come from all documents.
2. A word weighs (1 + ln tf) * idf * relevance. The relevance is `FLOOR` plus the lower confidence limit of
   the word's log odds ratio between toxic and clean examples. Plain TF-IDF ranks examples by topic and
   language and finds hardly half of the toxic rows; no word is left out by either.
3. The examples form a block-max inverted index; each document's nearest examples are found exactly:
   scarce words by their postings, common ones in blocks of examples, of which those are left out whose
   bound stays below the k-th best. An example with the document's own text never votes.
4. Votes weighted by cosine, examples that tie at the last place sharing what is left of it, are
   calibrated by a logistic curve, fitted on the examples' own votes without themselves.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import spread, written

WORD = re.compile(r"\w+")
LABELLED = 8192  # most labelled rows that are learned from
CHARS = 1 << 26  # most characters of their texts together
OTHER = 1 << 16  # buckets of words that no example holds
FLOOR = 0.05  # relevance of a word that says nothing
CONFIDENCE = 1.96  # standard errors taken off a log odds ratio
NEAREST = 15
BLOCK = 64
COMMON = 0.05  # share of the examples from which on a word is common
ROWS = 128  # documents searched at once
SLICE = 4096  # document frequencies in a row
PART = 4 << 20  # bytes of the packed index in a row
HELD = 10.0  # examples that the uncalibrated shares are worth in the calibration
TIE = 1e-9  # cosines this near count as equal


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """At most `most` labelled rows outside the held-out fold: doc_id, toxic. Labels other than 0 and 1 are none; ids with both count as 1."""
    d = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return d.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def examples_of(docs: DataFrame, rows: DataFrame, chars: int = CHARS) -> DataFrame:
    """doc_id (the smallest), mark, text and toxic (mean) of each text of the labelled rows; a repeated id counts by its text of the smallest mark.

    docs: doc_id, mark, text. rows is bounded by LABELLED, and so is the result. In order of mark, texts are
    taken while they have `chars` characters together at most, which bounds what goes to driver and executors.
    """
    d = docs.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min(F.struct("mark", "text")).alias("t"), F.max("toxic").alias("toxic"))
    d = d.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic")).select("doc_id", "t.mark", "t.text", "toxic")
    size = F.coalesce(F.length("text"), F.lit(0))
    total = F.sum(size).over(Window.orderBy("mark", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # LABELLED rows
    return d.where(size <= chars).withColumn("_total", total).where(F.col("_total") <= chars).drop("_total")


class Vocabulary:
    """Numbers of words: the examples' words in order, then the buckets. Only who counts words, which the driver doesn't, gets them as a dictionary."""

    def __init__(self, words: pa.Array):
        self.__setstate__(words)

    def __getstate__(self) -> pa.Array:
        return self.words

    def __setstate__(self, words: pa.Array) -> None:
        self.words = words

    @cached_property
    def number(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def __len__(self) -> int:
        return len(self.words) + OTHER

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of a text, rising, and how often each is there."""
        found: dict[int, int] = {}
        known, named = self.number.get, len(self.number)
        for w, n in Counter(WORD.findall((text or "").lower())).items():
            i = known(w)
            if i is None:
                i = named + zlib.crc32(w.encode(errors="surrogatepass")) % OTHER
                n += found.get(i, 0)
            found[i] = n
        t, n = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        order = np.argsort(t)
        return t[order], n[order]


def vocabulary(known: DataFrame) -> pa.Array:
    """All words of the examples (text), sorted. known is bounded by LABELLED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[str] = set()
            for t in b.column(0):
                found.update(WORD.findall((t.as_py() or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["word"])

    words = known.select("text").mapInArrow(run, "word string").distinct().toArrow().column(0).combine_chunks()
    return words.take(pc.sort_indices(words))


def frequencies(docs: DataFrame, words, size: int) -> np.ndarray:
    """Documents that hold each word. words: the broadcast vocabulary, whose size bounds what a task sends: one row for each SLICE of it."""
    slices = -(-size // SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slices * SLICE, np.int64)
        for b in batches:
            for t in b.column(0):
                n[words.value.count(t.as_py())[0]] += 1
        some = np.flatnonzero(n.reshape(slices, SLICE).any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([n[s * SLICE : (s + 1) * SLICE].astype("<i8").tobytes() for s in some], pa.binary())], ["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(n, "<i8")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["slice", "n"])

    parts = docs.select("text").mapInArrow(run, "slice int, n binary").repartition("slice").mapInArrow(add, "slice int, n binary")
    out = np.zeros(slices * SLICE, np.int64)
    for r in parts.collect():  # as many rows as slices
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["n"], "<i8")
    return out[:size]


def vectors(known: DataFrame, words) -> DataFrame:
    """doc_id, mark, toxic, and the numbers and counts of the words of each example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words.value.count(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([t for t, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["doc_id", "mark", "toxic", "words", "counts"])

    return known.select("doc_id", "mark", "toxic", "text").mapInArrow(run, "doc_id long, mark long, toxic double, words array<long>, counts array<long>")


def relevance(words: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """FLOOR plus the lower confidence limit of each word's absolute log odds ratio between toxic and clean examples."""
    a, b = np.full(size, 0.5), np.full(size, 0.5)
    for t, y in zip(words, toxic, strict=True):
        a[t] += y
        b[t] += 1 - y
    c, d = toxic.sum() + 1 - a, (1 - toxic).sum() + 1 - b
    return FLOOR + np.maximum(np.abs(np.log(a * d / (b * c))) - CONFIDENCE * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d), 0)


def weigh(words: np.ndarray, counts: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The unit vector's weights; worth is idf times relevance."""
    w = (1 + np.log(counts)) * worth[words]
    return w / np.sqrt((w * w).sum()) if len(w) else w


class BlockMaxIndex:
    """Unit vectors of examples: postings of scarce terms, and the common ones in blocks of examples with each term's largest weight."""

    def __init__(self, ids: list[int], marks: list[int], toxic: list[float], terms: list, weights: list[np.ndarray], n_terms: int):
        n = len(ids)
        # examples with the same leading term lie together, which keeps the bounds tight
        order = sorted(range(n), key=lambda i: (int(terms[i][int(np.argmax(weights[i]))]) if len(terms[i]) else -1, ids[i]))
        t = np.concatenate([np.asarray(terms[i], np.int64) for i in order]) if n else np.zeros(0, np.int64)
        w = np.concatenate([np.asarray(weights[i], np.float32) for i in order]) if n else np.zeros(0, np.float32)
        at = np.repeat(np.arange(n, dtype=np.int32), [len(terms[i]) for i in order])
        by = np.argsort(t, kind="stable")
        ids, marks, toxic = (np.array([v[i] for i in order], kind) for v, kind in ((ids, np.int64), (marks, np.int64), (toxic, float)))
        self.__setstate__((ids, marks, toxic, at[by].astype(np.min_scalar_type(max(n, 1))), w[by], np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n_terms))])))

    def __getstate__(self) -> tuple:
        """All postings by term, without the blocks, which are as large again."""
        return self.sent

    def __setstate__(self, sent: tuple) -> None:
        self.ids, self.marks, self.toxic, places, weights, starts = self.sent = sent
        n, df = len(self.ids), np.diff(starts)
        common = np.flatnonzero(df > COMMON * n)
        self.column = np.full(len(df), -1, np.int32)
        self.column[common] = np.arange(len(common))
        blocks = max(1, -(-n // BLOCK))
        self.head = np.zeros((blocks * BLOCK, len(common)), np.float32)
        for c, t in enumerate(common):
            self.head[places[starts[t] : starts[t + 1]], c] = weights[starts[t] : starts[t + 1]]
        self.most = self.head.reshape(blocks, BLOCK, -1).max(1)
        self.places, self.weights, self.starts = places, weights, starts
        self.place = {m: p for p, m in enumerate(self.marks.tolist())}

    def search(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row (term numbers, weights): cosines and places of its k nearest examples that share a term, nearest first, ties by id.

        Examples that tie with the k-th all come. but: the mark of the text that a row must not meet.
        Candidates come from sums in single precision with slack; their cosines are summed in double.
        """
        n, slots = len(self.ids), len(self.head)
        if not n:
            return [(np.zeros(0), np.zeros(0, np.int64)) for _ in rows]
        single, slack = np.zeros((len(rows), self.head.shape[1]), np.float32), 1e-5
        q = np.zeros(single.shape)
        tail = np.zeros((len(rows), slots))
        for r, (t, w) in enumerate(rows):
            t, w = np.asarray(t, np.int64), np.asarray(w, float)
            c = self.column[t]
            q[r, c[c >= 0]] = w[c >= 0]
            t, w = t[c < 0], w[c < 0]
            size = self.starts[t + 1] - self.starts[t]
            if size.sum():
                p = np.arange(size.sum()) + np.repeat(self.starts[t] - np.cumsum(size) + size, size)
                tail[r] = np.bincount(self.places[p], np.repeat(w, size) * self.weights[p], slots)
            if but is not None and (own := self.place.get(but[r])) is not None:
                tail[r, own] = -9.0
        single[:] = q
        # the k-th best of a few examples bounds the k-th best of all from below
        least = np.full(len(rows), -np.inf)
        if n > k:
            few = np.argpartition(-tail[:, :n], k - 1, axis=1)[:, :k]
            least = np.array([(tail[r, f] + self.head[f] @ single[r]).min() for r, f in enumerate(few)]) - slack
        bounds = single @ self.most.T + tail.reshape(len(rows), -1, BLOCK).max(2) + slack
        score = np.full((len(rows), slots), -np.inf, np.float32)
        for b in range(bounds.shape[1]):
            asks = np.flatnonzero(bounds[:, b] >= least)
            if len(asks):
                here = slice(b * BLOCK, (b + 1) * BLOCK)
                score[asks, here] = single[asks] @ self.head[here].T + tail[asks, here]
        score = score[:, :n]
        kth = np.partition(score, n - min(k, n), axis=1)[:, n - min(k, n)] - 2 * slack
        out = []
        for r in range(len(rows)):
            at = np.flatnonzero(score[r] >= kth[r])
            exact = tail[r, at] + (self.head[at] * q[r]).sum(1)
            at, exact = at[exact > 0], exact[exact > 0]
            order = np.lexsort((self.ids[at], -exact))
            at, exact = at[order], exact[order]
            keep = int((exact >= exact[k - 1] - TIE).sum()) if len(exact) > k else len(exact)
            out.append((exact[:keep], at[:keep]))
        return out


def vote(cosines: np.ndarray, toxic: np.ndarray, k: int, prior: float) -> float:
    """Share of toxic among the votes, each as heavy as its cosine, and one vote of the prior. Those that tie at the k-th place share what is left of it."""
    w = cosines
    if len(w) > k:
        tied = w <= w[k - 1] + TIE
        w = np.where(tied, w * (k - (~tied).sum()) / tied.sum(), w)
    return float((w @ toxic + prior) / (w.sum() + 1))


def calibration(raw: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope, 0 at least, and offset of the logistic curve over the log odds of raw shares that fits toxic best; few examples leave the shares as they are."""
    m, start = np.stack([np.log(raw / (1 - raw)), np.ones(len(raw))], 1), np.array([1.0, 0.0])
    at = start
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ at, -30, 30)))
        at = at + np.clip(np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + HELD * np.eye(2), m.T @ (toxic - p) - HELD * (at - start)), -2, 2)
    return max(float(at[0]), 0.0), float(at[1])


class Learned:
    """What the scores need, as the vocabulary's words and the bytes of `packed`. A task gets them as `known`: vocabulary, worth of its words, index, prior."""

    def __init__(self, words: pa.Array, parts: pa.ChunkedArray):
        self.words, self.parts = words, parts

    def __getstate__(self) -> tuple:
        return self.words, self.parts

    def __setstate__(self, sent: tuple) -> None:
        words, parts = sent
        self.known = (Vocabulary(words), *pickle.loads(b"".join(p.as_buffer() for p in parts)))


def packed(known: DataFrame, words, idf, prior: float) -> pa.ChunkedArray:
    """Worth of the words, index of the examples and prior, pickled, as parts of PART bytes in order. words, idf: broadcasts.

    One task makes them, from examples that LABELLED and CHARS bound; the driver only passes them on, and
    needs no more memory than they do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            lists = (np.split(v.flatten().to_numpy(), np.cumsum(pc.list_value_length(v).to_numpy())[:-1]) for v in (b.column(3), b.column(4)))
            rows.extend(zip(*(b.column(i).to_pylist() for i in range(3)), *lists, strict=True) if b.num_rows else ())
        if not rows:
            return
        rows.sort(key=lambda r: r[0])  # sums don't depend on the order of arrival
        ids, marks, toxic, ts, cs = zip(*rows, strict=True)
        worth = idf.value * relevance(ts, np.array(toxic), len(idf.value))
        ws = [weigh(t, c, worth) for t, c in zip(ts, cs, strict=True)]
        out = memoryview(pickle.dumps((worth, BlockMaxIndex(ids, marks, toxic, ts, ws, len(worth)), prior), pickle.HIGHEST_PROTOCOL))
        for a in range(0, len(out), PART):
            yield pa.RecordBatch.from_arrays([pa.array([out[a : a + PART]], pa.binary())], ["part"])

    return vectors(known, words).repartition(1).mapInArrow(run, "part binary").toArrow().column(0)


def learn(d: DataFrame, labels: DataFrame, k: int):
    """What the scores need: a broadcast of vocabulary, worth of its words, index and prior, and the calibration. None without examples of both kinds.

    d: doc_id, mark, text. At most LABELLED examples, of CHARS characters together, are learned from. The
    driver gets their words, and their index as bytes that it sends to the executors.
    """
    sc = d.sparkSession.sparkContext
    rows = written(labelled(labels), "toxicity-labelled")
    known = written(examples_of(d, rows), "toxicity-known")
    n, total = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not 0 < total < n:
        return None
    vocab = Vocabulary(vocabulary(known))
    words = sc.broadcast(vocab)
    idf = sc.broadcast(np.log((1 + d.count()) / (1 + frequencies(d, words, len(vocab)))) + 1)
    index = sc.broadcast(Learned(vocab.words, packed(known, words, idf, (total + 0.1) / (n + 1))))
    words.destroy()
    idf.destroy()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = [s for s, _ in shares_of(index.value.known, b.column(1), b.column(0), k)]
            yield pa.RecordBatch.from_arrays([pa.array(shares, pa.float64()), b.column(2)], ["share", "toxic"])

    votes = known.select("mark", "text", "toxic").mapInArrow(alone, "share double, toxic double").toArrow()
    return index, calibration(votes.column(0).to_numpy(), votes.column(1).to_numpy())


def shares_of(known, texts: pa.Array, marks: pa.Array, k: int) -> Iterator[tuple[float, list[dict]]]:
    """The share of toxic votes of each whole text, and its three nearest examples."""
    words, worth, index, prior = known
    for a in range(0, len(texts), ROWS):
        rows = [(t, weigh(t, c, worth)) for t, c in (words.count(x.as_py()) for x in texts[a : a + ROWS])]
        for cosines, at in index.search(rows, k, marks[a : a + ROWS].to_pylist()):
            near = zip(index.ids[at[:3]].tolist(), cosines[:3].tolist(), index.toxic[at[:3]].tolist(), strict=True)
            yield vote(cosines, index.toxic[at], k, prior), [{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in near]


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, k: int = NEAREST) -> DataFrame:
    """doc_id, mark, held_out, score, predicted and evidence (nearest examples) of every document.

    Null text counts as empty; a text that shares no word with any example gets the calibrated prior.
    Without labelled rows of both kinds nothing can be told and every score is 0. A null doc_id
    has no label and is not held out. Repeated rows stay, and equal texts have equal scores: labels, lang,
    source and doc_id are no inputs of a score, and examples of the same text (by a 64-bit hash) don't
    vote for it. Labels other than 0 and 1 count as none. Other columns play no part.
    """
    d = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"))
    learned = learn(d, labels, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))
        for b in batches:
            scores, evidence = [0.0] * b.num_rows, [[]] * b.num_rows
            if learned is not None:
                index, (slope, offset) = learned
                shares, evidence = zip(*shares_of(index.value.known, b.column(2), b.column(1), k), strict=True)
                raw = np.array(shares)
                scores = 1 / (1 + np.exp(-(slope * np.log(raw / (1 - raw)) + offset)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "mark", "score", "evidence"])

    s = d.mapInArrow(run, "doc_id long, mark long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: double>>")
    return s.select("doc_id", "mark", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
