"""Text operators against brute force, with nulls, empties, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import tracemalloc
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from tidelog.llm import extract, lines, mixing, pieces, simhash, toxicity, warc, wavelet

DOCS = "doc_id long, text string, source string"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
EDGE = [None, "", " ", "a", "A b", "x " * 3000, "é́ İ. ß €😀", "line\n\nline\tend ", "▁▁ x", "don't <|endoftext|> 's", "a" * 4000, " " * 40, "\x00\x1c\x85"]


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or ["s"] * len(texts))[i]) for i, t in enumerate(texts)], DOCS)


def peak_mb(run):
    """Most memory that this process's Python, NumPy included, takes for run()."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def noise(n, seed=0, letters="abetion ▁\n é😀.,ingİ'!|<>1"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


# --- wavelet -----------------------------------------------------------------


def test_wavelet_answers_as_a_plain_array_does():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50, 3000), np.array([7]), np.full(1025, 3), rng.zipf(1.5, 5000) % 40000, np.zeros(0, int)):
        ids = ids.astype(np.uint32)
        w = wavelet.Wavelet(wavelet.build(ids, [1], [len(ids)]))
        assert (w.ids() == ids).all()
        at = rng.integers(0, max(len(ids), 1), 50 if len(ids) else 0)
        assert (w.access(at) == ids[at]).all()
        for t in [*np.unique(ids)[:5].tolist(), 99999]:
            places = np.flatnonzero(ids == t)
            assert w.count(t) == len(places)
            assert w.count(t, 10, 700) == ((places >= 10) & (places < 700)).sum()
            assert [w.find(t, k) for k in range(min(len(places), 4))] == places[:4].tolist()
            assert w.find(t, len(places)) == -1


def test_a_shard_of_one_very_long_text(monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD", 700)
    for n in (1, 699, 700, 701, 5000):
        ids = (np.random.default_rng(n).zipf(1.4, n) % 3000).astype(np.uint32)
        w = wavelet.Wavelet(wavelet.build(ids, [1], [n]))
        assert (w.ids() == ids).all() and (w.access(np.arange(n)) == ids).all()


def test_a_lookup_reads_one_chunk_a_plane():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 14, 400_000).astype(np.uint32)
    data = wavelet.build(ids, [1], [len(ids)])
    asked = []
    w = wavelet.Wavelet(lambda at, n: asked.append(n) or data[at : at + n])
    assert w.access(np.array([123_456]))[0] == ids[123_456]
    assert w.reads == 2 * w.levels + 1 and sum(asked) < len(data) / 3  # a chunk and the counts of each plane, and the alphabet
    token = int(ids[7])
    assert w.count(token) == (ids == token).sum() and w.places(token, np.arange(w.count(token))).tolist() == np.flatnonzero(ids == token).tolist()


def test_lines_of_very_long_texts(spark):
    """A line of megabytes and a text of very many lines: only what ten sources hold goes."""
    long, common = "y" * (3 << 20), "the same line everywhere"
    texts = [f"{common}\n{long}{i}" for i in range(2)] + ["\n".join(f"line {i} {k}" for k in range(20000)) + f"\n{common}" for i in range(2)] + [common] * 9
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.without_boilerplate(docs(spark, texts, [f"s{i}" for i in range(13)])).collect()}
    assert got[0] == (2, 0, texts[0]) and got[1] == (2, 1, f"{long}1")
    assert got[2] == (20001, 1, texts[2].removesuffix(f"\n{common}")) and got[12] == (1, 1, "")


def test_lookups_over_all_shards(spark):
    texts = noise(400, 3)
    d = docs(spark, texts)
    shards = wavelet.write(d.repartition(3), WORDS, shard=500)
    ids = np.concatenate([np.append(np.frombuffer(x, "<u4"), 2) for x in wavelet.WordIds(WORDS).encode(texts)])
    assert shards.count() > 5
    asked = [0, 1, 499, 500, 501, len(ids) - 1, len(ids), -1, None, 7, 7]
    got = {r["place"]: r["token"] for r in wavelet.at_places(shards, spark.createDataFrame([(x,) for x in asked], "place long")).collect()}
    assert got == {x: int(ids[x]) for x in (0, 1, 499, 500, 501, len(ids) - 1, 7)}
    for token in (2, int(ids[5]), 48_000):
        assert sum(r["n"] for r in wavelet.occurrences(shards, token).collect()) == (ids == token).sum()
        assert sorted(r["place"] for r in wavelet.found_at(shards, token).collect()) == np.flatnonzero(ids == token).tolist()


def test_wavelet_rejects_other_files():
    with pytest.raises(ValueError):
        wavelet.Wavelet(b"nope")


def test_word_ids_are_the_librarys_on_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = [x or "" for x in EDGE] + noise(800)
    got = wavelet.WordIds(WORDS).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_word_ids_where_letters_marks_and_digits_meet():
    """Cuts and lower case before the library must change nothing, whatever follows; slices of columns have offsets."""
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(WORDS), wavelet.WordIds(WORDS)
    odd = [*"aJHsSt12.,-'()<|> \n", "\u030c", "\u0331", "\u0338", "\u20e3", "é", "É", "ẞ", "İ", "Σ", "\u212a", "²", "ª", "中", "\u0e33", "\x85", "\x1c", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>"]
    for letters in (odd, [x for x in odd if "<" not in x and "|" not in x]):
        texts = [*noise(1500, 5, letters), "J\u030c J", "A\u030a.b", "", "1.2.3.4,a@B-c's"]
        want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        for given in (texts, pa.array(["x y", *texts]).slice(1)):
            assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(given)] == want


def test_words_of_known_parts_cost_the_library_nothing():
    from tokenizers import Tokenizer

    class Heard:
        def __init__(self, t):
            self.t = t

        def encode_batch_fast(self, texts, **more):
            heard.extend(texts)
            return self.t.encode_batch_fast(texts, **more)

    heard, w = [], wavelet.WordIds(WORDS)
    for name, t in list(vars(w).items()):
        if isinstance(t, Tokenizer):
            setattr(w, name, Heard(t))
    parts = ["mail", "example", "com", "the", "Heie", "otion"]
    texts = [f"{a}.{b}@{c.upper()},{k} ({b}-{a}) {k}.{k + 1}{k}" for a in parts for b in parts for c in parts for k in range(9)]
    got = w.encode(texts)
    assert sum(map(len, heard)) < 200, "each combination went to the library"
    t = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_token_shards_of_texts_beyond_a_piece(spark, monkeypatch):
    """Pieces of a batch end between texts; one longer than a piece is one, and encoded in parts."""
    from tokenizers import Tokenizer

    texts = ["", "a b", "word, " * 40, "", "x", "é" * 30, "y z " * 9, ""]
    want = {r["doc_id"]: tuple(r) for r in wavelet.documents(wavelet.write(docs(spark, texts), WORDS)).collect()}
    monkeypatch.setattr(wavelet, "PIECE", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = list(wavelet.pieces(batch))
    assert [x for p in got for x in p.column(1).to_pylist()] == texts and all(p.num_rows for p in got)
    assert max(sum(len(x.encode()) for x in p.column(1).to_pylist()) for p in got if p.num_rows > 1) <= 20
    w = wavelet.WordIds(WORDS)
    ids = [x for p in got for x in w.encode(p.column(1))]
    t = Tokenizer.from_file(WORDS)
    long = [x * 9 for x in (*noise(200, 6), *EDGE[1:]) if len(x) < 5000]
    assert [np.frombuffer(w.encode([x])[0], "<u4").tolist() for x in long] == [e.ids for e in t.encode_batch_fast(long, add_special_tokens=False)]
    assert [want[i][2] for i in range(len(texts))] == [len(x) // 4 + 1 for x in ids]


@pytest.mark.parametrize("shard", [1, 40, 1 << 20])
def test_token_shards_round_trip(spark, shard):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = EDGE + noise(30)
    d = docs(spark, texts).withColumnRenamed("source", "start")  # a clashing name
    order = sorted(range(len(texts)))
    want, at = {}, 0
    for i in order:
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.documents(wavelet.write(d.repartition(3), WORDS, shard=shard)).collect()}
    assert got == want


def test_token_shards_of_odd_tables(spark):
    assert wavelet.documents(wavelet.write(docs(spark, []), WORDS)).count() == 0
    d = spark.createDataFrame([(5, "a", "s"), (5, "a", "s"), (None, None, None)], DOCS)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"]) for r in wavelet.documents(wavelet.write(d, WORDS)).collect())
    assert got == [(-1, 0, 1), (5, 1, 2), (5, 3, 2)]


# --- pieces ------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_the_librarys(library):
    e = pieces.PieceEncoder(PIECES)
    texts = [x or "" for x in EDGE] + noise(1500) + [" " * k for k in range(70)] + ["a" + " " * k + "b" for k in range(40)]
    assert [e.encode(t) for t in texts] == library.encode(texts)
    assert [e.decode(e.encode(t)) for t in texts] == library.decode(library.encode(texts))


def test_piece_tables(spark, library):
    d = docs(spark, EDGE).withColumnRenamed("source", "n_tokens")
    ids = pieces.encoded(d, PIECES)
    assert {r["doc_id"]: list(r["piece_ids"]) for r in ids.collect()} == {i: library.encode(t or "") for i, t in enumerate(EDGE)}
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(ids, PIECES).collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(EDGE)}
    for r in pieces.fingerprints(d, PIECES).collect():
        x = library.encode(EDGE[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(x).encode()).hexdigest()
    assert pieces.fingerprints(docs(spark, []), PIECES).count() == 0


# --- simhash -----------------------------------------------------------------


def plain_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, distance=3):
    at = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= distance and at[j] < at[i]:
                    at[i] = at[j]
    return {i: min(ids[j] for j in range(len(ids)) if at[j] == at[k]) for k, i in enumerate(ids)}


def test_fingerprints():
    for t in [*EDGE, *noise(60)]:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(6)]
    texts = [*EDGE, *base, *base[:3]]
    for b in base:
        w = b.split()
        w[rng.randrange(200)] = "changed"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts).withColumnRenamed("source", "fp")).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(list(range(len(texts))), fps)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_lose_none_in_dense_and_cut_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 5)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 3), replace=False)) for c in centre for _ in range(40)} | set(rng.integers(0, 2**63, 100).tolist()))
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = plain_components(fps, fps)
    from tidelog.llm.components import components

    for bucket in (4096, 16):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {r["node"]: r["component"] for r in components(simhash.links(d)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(0)
    for n in (100, 10**6, 10**9, 10**11):
        parts = simhash.plan(rng.integers(0, 2**63, 500).astype(np.uint64), n)
        assert sum(t + 1 for _, t in parts) == 4
        bits = [b for p, _ in parts for b in p]
        assert len(bits) == len(set(bits))


def test_a_plan_needs_little_memory():
    sample = np.random.default_rng(4).integers(0, 2**63, simhash.SAMPLE).astype(np.uint64)
    sample[1::2] = sample[::2] ^ np.uint64(1 << 40)
    assert peak_mb(lambda: simhash.plan(sample, 10**6)) < 16
    for mask in (2**64 - 1, 0xFF0000, 0):
        d, far = np.bitwise_count(sample[:300, None] & np.uint64(mask) ^ sample[:300] & np.uint64(mask)), np.bitwise_count(sample[:300, None] ^ sample[:300]) > 3
        assert simhash._met(sample[:300], np.uint64(mask), 3) == [((d <= t) & far).sum() for t in range(4)]


# --- lines -------------------------------------------------------------------


def plain_lines(rows, min_sites):
    sites, first = {}, {}
    for i, t, s in rows:
        for x in {y.strip(" \t\n\x0b\x0c\r") for y in (t or "").split("\n")} - {""}:
            if s is not None:
                sites.setdefault(x, set()).add(s)
            if i is not None:
                first[x] = min(first.get(x, i), i)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    clean = lambda i, t: t if t is None else "\n".join(y for y in t.split("\n") if (x := y.strip(" \t\n\x0b\x0c\r")) not in bad or first[x] == i)
    return {(i, clean(i, t)) for i, t, _ in rows}


@pytest.mark.parametrize("min_sites", [2, 10])
def test_line_dedup(spark, min_sites):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice([f"common {rng.randrange(4)}", f" site {i % 12} ", f"own {i}", "", "\t"]) for _ in range(rng.randrange(8))), f"s{i % 14}") for i in range(200)]
    rows += [(1000 + i, "one passage of many sites\nown line %d" % i, f"s{i}") for i in range(min_sites)] + [(2000 + i, "too few", f"s{i}") for i in range(min_sites - 1)]
    rows += [(3000, None, "s1"), (3001, "", None), (3002, "too few", None), (3003, "common 1", "s1"), (3003, "common 1", "s1")]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS h", "'x' AS n_lines")
    got = lines.without_boilerplate(d, min_sites)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == plain_lines(rows, min_sites)
    assert got.count() == len(rows)


def test_line_dedup_of_odd_tables(spark):
    assert lines.without_boilerplate(docs(spark, [])).count() == 0
    d = spark.createDataFrame([(None, "a", f"s{i}") for i in range(12)] + [(7, "a", "s0")], DOCS)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in lines.without_boilerplate(d).collect()), key=repr)
    assert got == [(0, "")] * 12 + [(7, "a")]


# --- toxicity ----------------------------------------------------------------


def toxic_corpus(spark):
    rng = random.Random(6)
    words, bad = [f"w{i}" for i in range(200)], ["grub", "slime", "nastyword"]
    texts, labels = [], []
    for i in range(600):
        w = rng.choices(words, k=60)
        toxic = i % 6 == 0
        if toxic:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(60), b)
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    return docs(spark, texts + [None, ""]), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    d, labels = toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.scored(d.withColumnRenamed("source", "score"), labels).collect()}
    assert len(got) == 602
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got}
    held = [(r["predicted"], int(i % 6 == 0)) for i, r in got.items() if r["held_out"] and i < 600]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[600]["predicted"] == got[601]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(not toxicity_held(e["doc_id"]) for r in got.values() for e in r["evidence"])


def toxicity_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_toxicity_without_labels(spark):
    d, labels = toxic_corpus(spark)
    for l in (labels.where("false"), labels.where("toxic = 0"), labels.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic")):
        assert {r["score"] for r in toxicity.scored(d, l).collect()} == {0.0}
    assert toxicity.scored(d.where("false"), labels).count() == 0
    repeated = d.union(d.where("doc_id < 3")).union(spark.createDataFrame([(None, "grub slime", "s")], DOCS))
    assert toxicity.scored(repeated, labels.union(labels)).count() == 606


def test_block_max_search_is_exact():
    rng = np.random.default_rng(7)
    n, v = 700, 40
    terms = [np.sort(rng.choice(v, rng.integers(1, 8), replace=False)).tolist() + [v] for _ in range(n)]
    weights = [(w := rng.random(len(t))) / np.sqrt((w * w).sum()) for t in terms]
    full = np.zeros((n, v + 1))
    for i, (t, w) in enumerate(zip(terms, weights, strict=True)):
        full[i, t] = w
    ix = toxicity.BlockMaxIndex(list(range(n)), list(range(n)), [0] * n, terms, weights, v + 1)
    for i in range(0, n, 13):
        want = sorted(((-float(s), j) for j, s in enumerate(full @ full[i])))[:15]
        got, at = ix.search([(terms[i], weights[i])], 15)[0]
        assert np.allclose(got, [-s for s, _ in want])
        assert ix.ids[at[0]] == i
        assert i not in ix.ids[ix.search([(terms[i], weights[i])], 15, [i])[0][1]]


def plain_scores(docs_, labels, k=15):
    """scored() by plain loops: texts (id, text), labels (id, toxic); score by text."""
    import math
    import re
    from collections import Counter

    named = {i: max(t for j, t in labels if j == i and t in (0, 1)) for i, t in labels if i is not None and t in (0, 1) and not toxicity_held(i)}
    by_id = {}
    for i, t in docs_:
        if i in named:
            by_id.setdefault(i, []).append(t)
    assert all(len(set(t)) == 1 for t in by_id.values())
    by_text = {}
    for i, t in by_id.items():
        by_text.setdefault(t[0], []).append(named[i])
    ex = [(t, sum(y) / len(y)) for t, y in by_text.items()]
    vocabulary = {w for t, _ in ex for w in re.findall(r"\w+", (t or "").lower())}
    name = lambda w: w if w in vocabulary else zlib.crc32(w.encode()) % toxicity.OTHER
    bag = lambda t: Counter(name(w) for w in re.findall(r"\w+", (t or "").lower()))
    df = Counter(w for _, t in docs_ for w in bag(t))
    total, toxic = len(ex), sum(y for _, y in ex)

    bags = [(bag(t), y) for t, y in ex]

    def worth(w):
        a = 0.5 + sum(y for t, y in bags if w in t)
        b = 0.5 + sum(1 - y for t, y in bags if w in t)
        c, d = toxic + 1 - a, total - toxic + 1 - b
        r = toxicity.FLOOR + max(0, abs(math.log(a * d / b / c)) - 1.96 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
        return (math.log((1 + len(docs_)) / (1 + df[w])) + 1) * r

    memo = {}

    @cache
    def vector(t):
        v = {w: (1 + math.log(n)) * (memo[w] if w in memo else memo.setdefault(w, worth(w))) for w, n in bag(t).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vs = [(t, y, vector(t)) for t, y in ex]

    def share(t):
        v = vector(t)
        near = sorted(((sum(x * u.get(w, 0) for w, x in v.items()), y) for t2, y, u in vs if t2 != t), reverse=True)
        near = [(c, y) for c, y in near if c > 1e-12]
        votes, seats = [], k
        while near and seats > 0:
            tied = [x for x in near if x[0] >= near[0][0] - 1e-9]
            votes += [(c * min(1, seats / len(tied)), y) for c, y in tied]
            seats, near = seats - len(tied), near[len(tied) :]
        prior = (toxic + 0.1) / (total + 1)
        return (sum(c * y for c, y in votes) + prior) / (sum(c for c, _ in votes) + 1)

    slope, offset = toxicity.calibration(np.array([share(t) for t, _ in ex]), np.array([y for _, y in ex]))
    return {t: 1 / (1 + math.exp(-(slope * math.log((p := share(t)) / (1 - p)) + offset))) for t in {t for _, t in docs_}}


def test_toxicity_is_the_plain_nearest_neighbour_vote(spark):
    """Every score of a whole table, with repeats, ties, nulls, empties, unknown words, a long text and labels other than 0 and 1."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 12)) + ["slime"] * (i % 5 == 0)) for i in range(130)]
    texts += texts[:20] + [" ".join(reversed(t.split())) for t in texts[20:40]] + [None, "", "never seen words", " ".join(rng.choices(words, k=30000))]
    d = docs(spark, texts)
    labels = [(i, int(i % 5 == 0) if i < 130 else int(rng.random() < 0.3)) for i in range(0, 170, 1) if i % 7] + [(1, 2), (3, None), (None, 1), (5, 0), (171, 0), (999, 1)]
    got = toxicity.scored(d.union(d.where("doc_id < 5")), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(texts) + 5
    want = plain_scores([(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts[:5])], labels)
    assert all(abs(r["score"] - want[texts[r["doc_id"]]]) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_examples_are_bounded_in_rows_and_characters(spark):
    d = docs(spark, ["a" * 10, "b" * 20, "a" * 10, "c" * 500, None]).selectExpr("doc_id", "xxhash64(text) AS mark", "text")
    rows = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    got = {r["text"]: (r["doc_id"], r["toxic"]) for r in toxicity.examples_of(d, rows).collect()}
    assert got == {"a" * 10: (0, 0.0), "b" * 20: (1, 1.0), "c" * 500: (3, 1.0), None: (4, 0.0)}
    assert {r["text"] for r in toxicity.examples_of(d, rows, 30).collect()} == {"a" * 10, "b" * 20, None}
    assert sum(len(r["text"] or "") for r in toxicity.examples_of(d, rows, 25).collect()) <= 25
    assert toxicity.labelled(spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int"), 7).count() == 7


def test_no_own_label_in_a_score(spark):
    """Flipping a row's own label, or its copies', leaves the vote as it was: only the fit of all examples moves a little."""
    d, labels = toxic_corpus(spark)
    clean = next(i for i in range(1, 600) if i % 6 and not toxicity_held(i))
    one = lambda l: next(r for r in toxicity.scored(d, l).collect() if r["doc_id"] == clean)
    a, b = one(labels), one(labels.selectExpr("doc_id", f"IF(doc_id = {clean}, 1, toxic) AS toxic"))
    assert abs(a["score"] - b["score"]) < 0.02
    assert all(e["doc_id"] != clean for r in (a, b) for e in r["evidence"])


def test_toxicity_is_searched_over_all_words(spark):
    """Words that no log-likelihood test would pick still decide which examples are near, and every text is searched."""
    learned = [i for i in range(60) if not toxicity_held(i)][:12]
    texts = {i: f"alpha{n} beta{n} common" for n, i in enumerate(learned)}
    asked = {100 + n: f"beta{n} alpha{n} unseen{n}" for n in range(12)}
    d = spark.createDataFrame([(i, t, "s") for i, t in (texts | asked).items()] + [(200, "nothing shared", "s")], DOCS)
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(learned)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(d, labels, k=1).collect()}
    assert all(got[100 + n]["evidence"][0]["doc_id"] == i for n, i in enumerate(learned))
    assert {got[100 + n]["predicted"] for n in range(0, 12, 2)} == {0} and {got[100 + n]["predicted"] for n in range(1, 12, 2)} == {1}
    assert got[200]["evidence"] == []


def test_the_driver_holds_no_index_of_examples(spark):
    texts = [" ".join(f"w{i * 199 + j * (1 + i % 3)}" for j in range(200)) for i in range(1500)]
    d = spark.createDataFrame(docs(spark, texts).selectExpr("doc_id", "xxhash64(text) AS mark", "text").toArrow())
    labels = spark.range(1500).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    assert peak_mb(lambda: toxicity.learn(d, labels, 5)) < 24


# --- mixing ------------------------------------------------------------------


def plain_seats(weights, seats):
    q = sorted(((-w / (2 * k + 1), key, k) for key, w in weights.items() if w > 0 for k in range(seats)))[:seats]
    return {key: sum(1 for _, x, _ in q if x == key) for key in weights}


def test_bytes_that_are_no_text_decode_as_the_library_does(spark):
    import sentencepiece

    sp, e = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.encoder(PIECES)
    byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    word, rng = sp.encode("hello"), random.Random(4)
    for run in [[0xE2, 0x82], [0xE2, 0x82, 0xAC], [0xFF], [0xF0, 0x9F, 0x98, 0xE2, 0x82], *([rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xC0]) for _ in range(rng.randrange(1, 7))] for _ in range(200))]:
        ids = word + [byte[x] for x in run] + word
        assert e.decode(ids) == sp.decode(ids), run


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(8)
    for case in range(12):
        weights = {f"k{i:02d}": (0.0 if rng.random() < 0.2 else rng.choice([1.0, 2.0, 5.0, rng.random() * 100])) for i in range(rng.randrange(1, 12))}
        seats = rng.randrange(0, 60)
        d = spark.createDataFrame([(case, k, w, seats) for k, w in weights.items()], "g int, k string, w double, s long")
        got = {r["k"]: r["n"] for r in mixing.apportion(d, ["g"], "k", "w", "s", "n").collect()}
        assert got == plain_seats(weights, seats)


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    keys = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    stopped, total = {}, sum(sizes.values())
    while True:
        left = [k for k in keys if k not in stopped]
        share = (total - sum(stopped.values())) / max(sum(w[k] for k in left), 1)
        over = [k for k in left if share * w[k] > limit * sizes[k]]
        if not over:
            return stopped | {k: share * w[k] for k in left}
        stopped |= {k: limit * sizes[k] for k in over}


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["a", "b", "c", "d", "hot", "hot", "hot", "É", None])) for i in range(700)]
    rows += [(900 + i, "few words", "tiny") for i in range(5)] + [(990, None, "a"), (991, "", None), (1, rows[1][1], rows[1][2])]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "'x' AS target", "2 AS taken")
    got = mixing.mix(d, block=16, shard_rows=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d.repartition(7), block=16, shard_rows=100).collect()))
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert abs(own[0]["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 16
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]


# --- warc --------------------------------------------------------------------


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("size", [1, 256 << 20])
def test_warc_round_trip(spark, size):
    html = ["<p>a</p>", "", None, "é\r\n\r\nx" * 50, "<p>a</p>", "WARC/1.1\r\n\r\n", "é\r\n\r\nx" * 50]
    rows = [(i, f"http://e.org/{i}", h) for i, h in enumerate(html)] + [(None, None, "<p>a</p>"), (20, "a\r\nb: c", "once")]
    d = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS file", "1 AS offset")
    ix = warc.write(d, archive_bytes=size)
    got = warc.read(ix).collect()
    assert len(got) == len(rows)
    for i, _, h in rows:
        p = (h or "").encode()
        r = next(x for x in got if x["page_id"] == i)
        first = min(j for j, _, x in rows if j is not None and (x or "") == (h or ""))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert r["payload"] is None if i != first else bytes(r["payload"]) == p
    some = warc.read(ix.where("page_id % 2 = 0"))
    assert sorted(r["page_id"] for r in some.collect()) == [0, 2, 4, 6, 20]


def test_warc_of_odd_tables(spark):
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0
    d = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, None, "y"), (None, None, "y")], PAGES)
    kinds = sorted((r["page_id"] or 0, r["record_type"]) for r in warc.archived(d).collect())
    assert kinds == [(0, "response"), (0, "response"), (1, "response"), (1, "response"), (2, "revisit")]
    assert {r["record_type"] for r in warc.read(warc.write(d, min_bytes=2)).collect()} == {"response"}


def test_warc_records_have_ids_of_their_own_and_say_what_they_revisit(spark):
    import gzip

    d = spark.createDataFrame([(1, "http://a", "x")] * 3 + [(2, "http://b", "x")] * 2 + [(3, None, "")], PAGES)
    raw = [gzip.decompress(open(r["file"].removeprefix("file://").removeprefix("file:"), "rb").read()[r["offset"] : r["offset"] + r["length"]]).decode() for r in warc.write(d, date="2024-05-06T07:08:09Z").collect()]
    fields = [dict(x.split(": ", 1) for x in r.split("\r\n\r\n")[0].split("\r\n")[1:]) for r in raw]
    assert len({f["WARC-Record-ID"] for f in fields}) == 6
    assert {f["WARC-Date"] for f in fields} == {"2024-05-06T07:08:09Z"}
    later = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert [(f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"], f["X-Refers-To-Page-Id"]) for f in later] == [("http://a", "2024-05-06T07:08:09Z", "1")] * 2


def test_warc_is_read_by_as_many_tasks_as_its_bytes_ask_for(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(i, "u", rng.bytes(20000).hex()) for i in range(300)], PAGES).repartition(3)
    ix = warc.write(d)
    total = ix.agg({"length": "sum"}).first()[0]
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 19)
    records = warc.read(ix)
    assert records.rdd.getNumPartitions() >= total / (1 << 19) > 8
    assert records.count() == 300


def test_one_long_payload_is_one_record(spark):
    long = "é<p>" * (3 << 20)
    d = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "x")], PAGES)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], None if r["payload"] is None else bytes(r["payload"]) == long.encode()) for r in warc.read(warc.write(d)).where("page_id < 3").collect()}
    assert got == {1: (len(long.encode()), "response", True), 2: (len(long.encode()), "revisit", None)}


def test_warc_ranges_are_merged():
    got = list(warc.ranges([("a", 0, 10), ("a", 12, 5), ("a", 100, 5), ("b", 0, 5)], gap=4, most=1000))
    assert got == [("a", 17, [(0, 10), (12, 5)]), ("a", 105, [(100, 5)]), ("b", 5, [(0, 5)])]
    assert len(list(warc.ranges([("a", 0, 10), ("a", 10, 10)], gap=4, most=15))) == 2


def test_a_damaged_record_is_an_error():
    raw, _ = warc.record(1, "u", b"payload", None, "here", "2024-01-01T00:00:00Z")
    plain = zlib.decompress(raw, 31)
    assert warc.parse(plain)["payload"] == b"payload"
    for bad in (plain.replace(b"payload", b"peyload"), plain[:-3], b"x"):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)


# --- extraction --------------------------------------------------------------


CASES = [
    ("<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now</div><article><h1>T &amp; U</h1><p><b>First\n  words.<br><p>Second&nbsp;one</article><footer>&copy; me</footer>", "T & U\nFirst words.\nSecond one"),
    ("<body><header>Site</header><main><header><h1>Title</h1></header><p>Body text here.</p><form><p>Name</p></form></main><aside>side</aside>", "Title\nBody text here."),
    ("<div id=comments><p>A long reader comment that has many words in it</p></div><div><p>Short.</p><p>Text.</p></div>", "Short.\nText."),
    ("<script>var a = '<p>x</p>';</script><style>p{}</style><p>only</p><!-- <p>no</p> -->", "only"),
    ("<div class=cookie-notice>We use cookies</div><ul><li>one<li>two</ul>", "one\ntwo"),
    ("plain < text &lt;b&gt;", "plain < text <b>"),
    ("<p>a<p hidden>b</p><p style='display: none'>c</p>", "a"),
    ("<article><p>x</p><div class='comments'><p>y</p></div><textarea>z</textarea></article>", "x"),
    ("<p title='a>b'>q</p>", "q"), ("<p title=don't>it isn't</p>", "it isn't"), ("<!--><p>a</p><!---><p>b</p><!-- x > y --><p>c</p>", "a\nb\nc"), ('<p class="x>b" id=\"y>c</p>', "c"),
    ("<div" * 3, "<div<div<div"),
    ("", ""), ("<nav>x</nav>", ""), ("<p></p>", ""),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert extract.main_text(html) == text


ARTICLE = "<p>First of three paragraphs in the story.</p><p>The second one has more to say than that.</p><p>And the third ends it.</p>"
STORY = "First of three paragraphs in the story.\nThe second one has more to say than that.\nAnd the third ends it."


@pytest.mark.parametrize("page", [
    f'<div class="content with-sidebar">{ARTICLE}</div>', f'<body class="has-nav"><div class="has-nav">{ARTICLE}</div>', f'<div class="page menu-open"><article>{ARTICLE}</article></div>',
    f'<div class="post-share story">{ARTICLE}</div>', f'<div class="entry hidden-print">{ARTICLE}</div>', f'<div id="search-results-story">{ARTICLE}</div>',
    f'<form id="aspnetForm"><div class="nav"><a href=/>Home</a></div><div>{ARTICLE}</div><input></form>', f'<div class="sidebar"><main>{ARTICLE}</main></div>',
    f'<div class="content sidebar">{ARTICLE}</div><p>x</p>', f'<div class="popup">{ARTICLE}</div>', f'<div hidden class=page><article>{ARTICLE}</article></div>',
    f'<div class="story">{ARTICLE}<div class="comments"><p>{"A reader says a lot. " * 40}</p></div></div>',
    f'<article>{ARTICLE}</article><section class="comments"><article class="comment"><p>{"A reader says a lot. " * 40}</p></article></section>',
    f'<div class="story">{ARTICLE}<div class="share-links"><a href=/>Share</a></div></div><div class="ad-box">Buy now and save.</div>',
])
def test_names_give_way_to_density(page):
    """Layout classes, forms around a page and names on what holds the article don't lose it; what is no main text still goes."""
    assert extract.main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>me</footer>") == STORY


@pytest.mark.parametrize("part", ["<a x", '<a x="> ', "<a x='>\"", "<a =\"'", '<a "', "<a '", "<b></i>", "<i><div><b></i>", "<!x", "<script", "<p><li></b>", '<a ">" ', "<nav><b></i>", "</p", "&", "<table><tr><td>"])
def test_extraction_takes_time_in_proportion(part):
    """Broken marks, with and without an end: a quarter of a megabyte takes a second or two, a whole one that four times."""
    import time

    for size, end in ((1 << 18, ""), (1 << 18, "<p>end"), (1 << 20, ">")):
        begun = time.perf_counter()
        extract.main_text("<ul><li>" + part * (size // len(part)) + end)
        assert time.perf_counter() - begun < 30


def plain_density(page):
    """main_text's choice for well-formed pages of blocks and links without names, by plain recursion. page: (tag, items)."""
    import math

    def count(n):
        if isinstance(n, str):
            return len(n.replace(" ", "")), 0, 0, 0
        c, t, lc, lt = (sum(x) for x in zip((0, 0, 0, 0), *((a[0], a[1] + (not isinstance(x, str)), a[2], a[3]) for x in n[1] for a in [count(x)]), strict=True))
        return (c, t, c, t + 1) if n[0] == "a" else (c, t, lc, lt)

    c, _, lc, _ = count(page)
    ratio = lc / c if c else 0

    def density(n):
        c, t, lc, lt = count(n)
        if not c:
            return 0.0
        base = 1 + math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(base)

    def every(n, path):
        yield n, path
        for x in n[1]:
            if not isinstance(x, str):
                yield from every(x, [*path, n])

    total = lambda n: sum(density(x) for x in n[1] if not isinstance(x, str) and x[0] != "a")
    nodes = list(every(page, []))
    best, path = max(nodes, key=lambda x: total(x[0]))
    least = min(density(n) for n in [*path, best])

    def text(n, take):
        take = take or n is best or not any(n is p for p in path) and n[0] != "a" and density(n) >= least and count(n)[0] > 0
        parts, out = [], []
        for x in n[1]:
            if isinstance(x, str) or x[0] == "a":
                parts.append((x if isinstance(x, str) else "".join(x[1])) if take else "")
            else:
                out += ["".join(parts), *text(x, take)]
                parts = []
        return [*out, "".join(parts)]

    return "\n".join(y for x in (text(page, False) if total(best) > 0 else text(page, True)) if (y := " ".join(x.split())))


def test_density_chooses_as_plain_recursion_does():
    rng = random.Random(11)

    def words(n):
        return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(n)) + " "

    def block(depth):
        tag = rng.choice(["div", "section", "article", "blockquote"])
        items = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.35 and depth < 5:
                items.append(block(depth + 1))
            elif kind < 0.75:
                items.append(("p", [words(rng.choice([1, 5, 40])), *([("a", [words(2)])] if rng.random() < 0.3 else [])]))
            elif kind < 0.9:
                items.append(("ul", [("li", [("a", [words(2)])]) for _ in range(rng.randrange(1, 8))]))
            else:
                items.append(words(rng.choice([2, 10])))
        return tag, items

    def html(n):
        return n if isinstance(n, str) else f"<{n[0]}>{''.join(map(html, n[1]))}</{n[0]}>"

    for _ in range(400):
        page = ("body", [block(0) for _ in range(rng.randrange(1, 4))])
        assert extract.main_text("<html>" + html(page) + "</html>") == plain_density(page)


def test_extraction_keeps_a_long_page_whole_and_in_time():
    p = "".join(f"<p>word {i}</p>" for i in range(20000))
    assert extract.main_text(f"<body><nav>{'<a>x</a>' * 100}</nav><article>{p}</article>").count("\n") == 19999
    assert extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_extraction_table(spark):
    d = spark.createDataFrame([(1, None, CASES[0][0]), (2, "u", None), (2, "u", None), (None, "v", "<p>x")], PAGES).selectExpr("*", "'t' AS text")
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in extract.extracted(d).collect()), key=repr)
    assert got == [(0, "v", "x", 1), (1, "", CASES[0][1], len(CASES[0][1])), (2, "u", "", 0), (2, "u", "", 0)]
    assert extract.extracted(d.where("false")).count() == 0


def test_extraction_of_the_given_pages(spark):
    """The pages of the test data keep their text in one article of headings and paragraphs."""
    import re
    from html import unescape

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert extract.main_text(r["html"]) == "\n".join(b for b in blocks if b)
