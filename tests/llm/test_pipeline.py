"""The pipeline's stages, each held against brute force on its own input, and the registered queries."""

import math
import re
from collections import Counter

import duckdb
import sentencepiece

import corpus_pipeline as cp
from tidelog.llm import oracle

from ..conftest import SF
from .test_texts import PIECES, plain_components, plain_fingerprint, plain_lines, plain_scores


def test_stages(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicate", "mixing", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (docs.collect(), out.collect())
        if name != "pieces":
            assert out.columns == columns
        docs = out
    before, after = kept["toxicity"]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()]
    score = plain_scores([(r["doc_id"], r["text"]) for r in before], labels)
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if score[r["text"]] < 0.3)
    assert 0 < len(after) < len(before)
    before, after = kept["line_dedup"]
    want = plain_lines([(r["doc_id"], r["text"], r["source"]) for r in before], 10)
    old = {r["doc_id"]: r["text"] for r in before}
    assert {(r["doc_id"], r["text"]) for r in after} == {(i, t) for i, t in want if t == old[i] or re.search(r"\S", t)}
    before, after = kept["near_duplicate"]
    ids = [r["doc_id"] for r in before]
    assert sorted(r["doc_id"] for r in after) == sorted(set(plain_components(ids, [plain_fingerprint(r["text"]) for r in before]).values()))
    before, after = kept["mixing"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert after and all(texts[r["doc_id"]] == r["text"] for r in after)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near_duplicate/*.parquet'")
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({oracle.SQL['op9_mixing']})").fetchall()
    assert Counter(r["doc_id"] for r in after) == Counter({i: math.floor(t / n + 0.5) for i, n, t in taken if n and t / n >= 0.5})
    before, after = kept["pieces"]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in after) == sorted((r["doc_id"], len(sp.encode(r["text"] or ""))) for r in before)


def test_run_gives_the_last_stage(spark):
    d = cp.run(spark, SF)
    assert d.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and d.count() > 0


def test_repeated_and_null_documents(spark):
    d = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (None, "a b c d", "en", "s", 7), (None, None, None, None, None), (2, None, "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in cp.near_duplicate(spark, d, SF).collect()))
    assert got == [(1, "a b c d"), (2, "")]
    assert cp.line_dedup(spark, d, SF).count() == 5
    for _, stage in cp.STAGES:
        assert stage(spark, d.where("false"), SF).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(e.oracle_sql()) <= set(names)


def test_run_leaves_only_what_its_result_reads(spark):
    from tidelog.llm import common

    before = len(common._made)
    cp.run(spark, SF).count()
    assert [p.rpartition("/")[2].rpartition("-")[0] for p in common._made[before:]] == [f"stage-{n}" for n, _ in cp.STAGES[:-1]]


def test_sql_agrees(spark):
    from tidelog.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = con.execute(sql)
        rows, cols = got.fetchall(), [c[0] for c in got.description]
        d = queries.queries()[name](spark, SF)
        assert sorted(d.columns) == sorted(cols)
        norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(norm, map(tuple, d.select(cols).collect())), key=repr) == sorted(map(norm, rows), key=repr), name
