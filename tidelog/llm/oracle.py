"""SQL, as DuckDB reads it, for those queries that SQL can express."""

from __future__ import annotations

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {10 * g + 1}, 10))::UBIGINT >> {s}) & 31 AS INTEGER) + 1, 1)" for g in range(4) for s in range(35, -1, -5))

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a AS id, a AS other FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.other = p.a
), c AS (SELECT id, min(other) AS least FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.id
"""

_BARE = r"regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP5 = f"""
WITH l AS (
  SELECT DISTINCT doc_id, source, {_BARE.replace("x,", "line,", 1)} AS line
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
), b AS (
  SELECT line, min(doc_id) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), g AS (
  SELECT l.doc_id, list(DISTINCT l.line) AS gone FROM l JOIN b ON l.line = b.line WHERE l.doc_id IS DISTINCT FROM b.first GROUP BY l.doc_id
), k AS (
  SELECT d.doc_id, text, len(string_split(text, chr(10))) AS n, CASE WHEN gone IS NULL THEN string_split(text, chr(10))
    ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, {_BARE})) END AS kept
  FROM documents d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
), t AS (SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(n - len(kept), 0) AS n_removed, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text FROM k)
SELECT doc_id, n_lines, n_removed, length(text) AS kept_chars, md5(text) AS kept_md5 FROM t
"""

OP7 = f"""
WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, url, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, {_BASE32} AS payload_digest, payload_bytes
FROM p
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce('s' || source, 'n') AS k, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw
  FROM documents
), b AS (SELECT *, ('0x' || substr(draw, 1, 12))::BIGINT AS bucket FROM d),
s AS (SELECT k, source, sum(size)::BIGINT AS source_size, CAST(ceil(count(*) / 4096.0::DOUBLE) AS BIGINT) AS shards FROM b GROUP BY ALL),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
v AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT k, source_size, shards, CAST(round(total / 64.0::DOUBLE) AS BIGINT) AS blocks,
    CASE WHEN cap / weight <= level THEN cap ELSE max(CASE WHEN cap / weight > level THEN level END) OVER () * weight END AS target
  FROM v
), q AS (
  SELECT k, count(*) AS quota FROM (
    SELECT k, blocks, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, k) AS r FROM (SELECT *, unnest(range(blocks)) AS j FROM t) WHERE target > 0
  ) WHERE r <= blocks GROUP BY k
), c AS (SELECT b.k, bucket % shards AS shard, sum(size)::BIGINT AS size FROM b JOIN t ON b.k = t.k GROUP BY ALL),
e AS (
  SELECT k, shard, count(*) AS quota FROM (
    SELECT k, shard, quota, row_number() OVER (PARTITION BY k ORDER BY size / (2.0::DOUBLE * j + 1) DESC, shard) AS r
    FROM (SELECT c.*, quota, unnest(range(quota)) AS j FROM c JOIN q ON c.k = q.k) WHERE size > 0
  ) WHERE r <= quota GROUP BY k, shard
), f AS (SELECT c.k, c.shard, c.size, coalesce(quota, 0) AS quota, least(coalesce(quota, 0) * 64, c.size * 3) AS take FROM c LEFT JOIN e ON c.k = e.k AND c.shard = e.shard),
g AS (
  SELECT doc_id, source, b.size, source_size, target, f.shard, quota, take, f.size AS cell,
    sum(b.size) OVER (PARTITION BY b.k, f.shard ORDER BY draw, doc_id NULLS FIRST, b.size ROWS UNBOUNDED PRECEDING) - b.size AS start
  FROM b JOIN t ON b.k = t.k JOIN f ON f.k = b.k AND f.shard = b.bucket % t.shards
), h AS (
  SELECT *, CAST(take // greatest(cell, 1) * size + greatest(least(take % greatest(cell, 1) - start, size), 0) AS BIGINT) AS taken FROM g
)
SELECT doc_id, source, size, source_size, target, shard, quota, taken, CASE WHEN size > 0 THEN CAST(round(taken / size::DOUBLE) AS INTEGER) ELSE 0 END AS copies FROM h
"""

SQL = {"op2_graphs": OP2, "op5_lines": OP5, "op7_warc": OP7, "op9_mixing": OP9}
