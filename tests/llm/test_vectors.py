"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import ann, graphs
from tidelog.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0] * 7 + [float("nan")], 1), (904, [1.0] * 7 + [None], 1), (905, [1.0] * 7 + [float("inf")], 1)]


def table(spark, x, labels, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v], int(l)) for i, (v, l) in enumerate(zip(x, labels, strict=True))], VECTORS)


def cloud(n=600, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n // 3):  # a dense group, copies and near copies
        x[i] = x[0] + rng.normal(size=d) * 0.02 * (i % 5)
    return x.astype(np.float32)


def plain_links(ids, x, labels, cosine=0.98):
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1))[:, None]
    g = (u @ u.T >= cosine - 1e-12) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(g, False)
    comp = np.array(ids)
    while True:
        low = np.minimum(comp, np.where(g, comp[None, :], 1 << 60).min(1))
        if (low == comp).all():
            return g.sum(1), comp
        comp = low


@pytest.mark.parametrize(("shard", "whole"), [(64, 16), (32, 1), (2048, 16)])
def test_embedding_near_duplicates(spark, monkeypatch, shard, whole):
    monkeypatch.setattr(graphs, "SHARD", shard)
    monkeypatch.setattr(graphs, "WHOLE", whole)
    x = cloud()
    labels = np.arange(len(x)) % 2
    d = table(spark, x, labels).union(spark.createDataFrame(ODD + [(906, [1.0] * 8, None), (907, [1.0] * 8, None), (908, [1.0] * 3, 1), (909, [2.0] * 3, 1)], VECTORS)).selectExpr("*", "1 AS node", "2 AS copies")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in graphs.near_duplicates(d).collect()}
    n, comp = plain_links(range(len(x)), x, labels)
    assert {i: got[i] for i in range(len(x))} == {i: (int(n[i]), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))}
    assert {i: got[i] for i in range(900, 908)} == {i: (0, i, True) for i in range(900, 908)}
    assert got[908] == (1, 908, True) and got[909] == (1, 908, False)
    nodes = graphs.nodes_of(d)
    found, _ = graphs.links(nodes)
    assert graphs.audit(nodes, found) == 1.0
    assert graphs.audit(nodes, found.withColumn("found", F.expr("found div 2"))) < 0.7


def test_a_hub_keeps_copies_that_are_out_of_each_others_range(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SHARD", 256)  # several blocks
    rng = np.random.default_rng(3)
    d = 256
    x = rng.normal(size=(800, d))
    x[:601, 0] = 0
    x[:601] *= np.sqrt(1 - 0.985**2) / np.sqrt((x[:601] ** 2).sum(1))[:, None]
    x[:601, 0] = 0.985
    x[0] = np.eye(d)[0]
    x = x.astype(np.float32)
    n, comp = plain_links(range(800), x, np.zeros(800))
    assert n[0] == 600 and (n[1:601] == 1).all()
    u = graphs._unit(x.astype(float))
    g = graphs.build(u)
    wide = max(map(len, g))
    adjacency = np.array([a + [i] * (wide - len(a)) for i, a in enumerate(g)])
    assert graphs.range_search(u, adjacency, u[:1], 0.98).sum() == 601
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in graphs.near_duplicates(table(spark, x, np.zeros(800))).collect()}
    assert got == {i: (int(n[i]), int(comp[i])) for i in range(800)}


def test_an_audit_that_fails_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(graphs, "audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="audited"):
        graphs.near_duplicates(table(spark, np.eye(3), [0, 0, 0]))


def test_labels_are_sharded_by_their_size():
    assert [graphs.level(n) for n in (1, 16 * 2048, 16 * 2048 + 1, 1 << 16, (1 << 16) + 1, 1 << 18, (1 << 18) + 1)] == [0, 0, 1, 1, 2, 2, 3]


def test_near_duplicates_of_odd_tables(spark):
    assert graphs.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    d = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], VECTORS)
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in graphs.near_duplicates(d).collect()), key=repr)
    assert got == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_long_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3000))
    x[30:] = x[:30] + 0.05 * rng.normal(size=(30, 3000))
    x = x.astype(np.float32)
    n, comp = plain_links(range(60), x, np.zeros(60))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in graphs.near_duplicates(table(spark, x, np.zeros(60))).collect()} == {i: (int(n[i]), int(comp[i])) for i in range(60)}


def test_prune_and_build():
    x = cloud(200).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    g = graphs.build(x)
    assert len(g) == 200 and all(i not in a and len(a) <= 2 * graphs.DEGREE for i, a in enumerate(g))
    assert graphs.build(x[:1]) == [[]]


def plain_nearest(ids, x, k):
    s = x.astype(float) @ x.astype(float).T
    out = {}
    for i, q in enumerate(ids):
        if q % 20 == 0:
            order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
            out[q] = [(v, -t) for t, v in order]
    return out


@pytest.mark.parametrize("block", [32, 4096])
def test_nearest_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    x = cloud(900, seed=5)
    x[700:760] = x[650]  # ties
    d = table(spark, x, np.zeros(len(x))).union(spark.createDataFrame(ODD + [(920, [1.0] * 7 + [None], 0)], VECTORS)).selectExpr("*", "1 AS list", "2 AS score")
    d = d.where("vec_id < 900 OR vec_id >= 900 AND label IS NOT NULL")
    found = ann.search(d, d.where("vec_id % 20 = 0"))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = plain_nearest(list(range(900)), x, 20)
    assert set(got) == set(want)
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.95
    assert abs(ann.recall(found, d, d.where("vec_id % 20 = 0"), most=1000) - hit) < 0.02
    for q, rows in got.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert np.allclose([s for _, s in rows], [float(x[q].astype(float) @ x[v].astype(float)) for v, _ in rows])


def test_repeated_queries_and_lengths(spark):
    """Equal query rows are one query, other vectors under the same id are their own; candidates of another length are none."""
    x = cloud(300, seed=9)
    d = table(spark, x, np.zeros(300)).union(table(spark, x[20:60], np.zeros(40), 20))  # repeated rows
    d = d.union(table(spark, x[100:101], [0], 40)).union(table(spark, np.random.default_rng(2).normal(size=(50, 5)), np.zeros(50), 1000))  # another vector of 40, another length
    rows = [(r["vec_id"], np.array(r["embedding"])) for r in d.collect()]
    want = []
    for i, q in {(i, v.tobytes()): (i, v) for i, v in rows if i % 20 == 0}.values():
        near = {(j, v.tobytes()): (-float(q @ v), j) for j, v in rows if j != i and len(v) == len(q)}
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(near.values())[:20])]
    got = [tuple(r) for r in ann.search(d, d.where("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted((i, r, round(s, 6)) for i, r, _, s in got) == sorted((i, r, round(s, 6)) for i, r, _, s in want)
    assert sum(i == 40 for i, *_ in got) == 40 and sum(i >= 1000 for i, *_ in got) == 3 * 20


def test_few_candidates(spark):
    d = table(spark, np.eye(3), [0, 0, 0])
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.search(d, d.where("vec_id = 0")).collect())
    assert got == [(1, 1, 0.0), (2, 2, 0.0)]
    assert ann.search(d.where("false"), d).count() == 0
    assert ann.search(d, d.where("false")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)]
    at = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    d = spark.createDataFrame([*edges, (None, 3), (5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(d).collect()}
    assert got == {v: c for v, c in at.items() if v != c}
    assert components(d.where("false")).count() == 0
