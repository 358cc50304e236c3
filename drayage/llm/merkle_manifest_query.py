from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm.merkle_manifest import build_manifest, leaf_of
from drayage.llm.registry import query
from drayage.plans.registry import Tables

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT] || range(8),
        lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t),
d AS (
    SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, source, lang, n_chars, text,
           CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(
               [4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
               lambda c, x: xor(c >> 8, t[((xor(c, x)) & 255) + 1])), 4294967295) % 2 = 0
           THEN replace(text, chr(10), '') ELSE text END AS tampered
    FROM documents, crc_table),
f AS (
    SELECT id, doc_id, source, concat(
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
        coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
        coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(tampered) || ':' || tampered, '-') AS other
    FROM d),
leaves AS (SELECT id, doc_id, source, sha256(head || body) AS leaf, sha256(head || other) AS claim FROM f),
tree AS (
    SELECT 0 AS level, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h,
           count(*) OVER (PARTITION BY source) AS n
    FROM leaves
    UNION ALL
    SELECT level, source, pos, h, count(*) OVER (PARTITION BY source) FROM (
        SELECT max(level) + 1 AS level, source, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
        FROM tree WHERE n > 1 GROUP BY source, pos // 3)),
subroots AS (SELECT source, level, h FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level, pos, h, count(*) OVER () FROM (
        SELECT max(level) + 1 AS level, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
        FROM top WHERE n > 1 GROUP BY pos // 3)),
placed AS (
    SELECT l.id, l.source, row_number() OVER (PARTITION BY l.source ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS pos FROM leaves l),
heads AS (SELECT source, level, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM subroots),
ways AS (
    SELECT p.id, t.level, t.pos, p.pos // (3 ** t.level)::BIGINT AS own, t.h
    FROM placed p JOIN tree t ON p.source IS NOT DISTINCT FROM t.source AND t.n > 1
        AND t.pos // 3 = (p.pos // (3 ** t.level)::BIGINT) // 3
    UNION ALL
    SELECT p.id, s.level + t.level, t.pos, s.place // (3 ** t.level)::BIGINT, t.h
    FROM placed p JOIN heads s ON p.source IS NOT DISTINCT FROM s.source
        JOIN top t ON t.n > 1 AND t.pos // 3 = (s.place // (3 ** t.level)::BIGINT) // 3),
paths AS (
    SELECT id, level, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS l,
           coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS r
    FROM ways GROUP BY id, level),
proofs AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY level)) AS proof, count(*) AS depth FROM paths GROUP BY id),
fold AS (
    SELECT id, 0 AS level, claim AS h FROM leaves
    UNION ALL
    SELECT f.id, f.level + 1, sha256(p.l || f.h || p.r) FROM fold f JOIN paths p ON p.id = f.id AND p.level = f.level),
ends AS (SELECT id, arg_max(h, level) AS folded_root FROM fold GROUP BY id)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = t.h AS verified
FROM leaves l JOIN ends e ON e.id = l.id JOIN heads s ON s.source IS NOT DISTINCT FROM l.source
    JOIN top t ON t.n = 1 LEFT JOIN proofs p ON p.id = l.id
"""


@query("op11_merkle_manifest", SQL)
def op11_merkle_manifest(t: Tables) -> DataFrame:
    without = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = [F.coalesce(without, F.col("text")) if f == "text" else F.col(f) for f in FIELDS]
    manifest = build_manifest(t.documents, FIELDS, key="doc_id", group="source", carried={"found": leaf_of(found)})
    return manifest.proofs("doc_id", claim="found")
