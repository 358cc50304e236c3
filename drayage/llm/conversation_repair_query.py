from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm.conversation_repair import repair
from drayage.llm.registry import query
from drayage.plans.registry import Tables

SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT] || range(8),
        lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t),
src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295::BIGINT] || list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
        lambda c, x: xor(c >> 8, t[((xor(c, x)) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc_table),
rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM src, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END)),
placed AS (
    SELECT *, row_number() OVER w AS rn, lag(left(role, 1)) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n,
           trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
    SELECT *, left(role, 1) AS initial, chr(10) || role || ':' || text AS own, ':' || text AS rest,
           CASE WHEN core = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
    FROM placed),
dp AS (  -- per state before row rn: cost, audit and rows from there on; 0 nothing yet, 1 system, 2 user, 3 assistant
    SELECT conv_id, n + 1 AS rn, {'c': 0, 'a': '', 'b': ''} AS s0,
           {'c': 6, 'a': 'II', 'b': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1,
           {'c': 3, 'a': 'I', 'b': chr(10) || 'assistant:'} AS s2, {'c': 0, 'a': '', 'b': ''} AS s3
    FROM judged WHERE rn = n
    UNION ALL
    SELECT conv_id, rn,
        list_sort([d0, {'c': d2.c + 3, 'a': 'I' || d2.a, 'b': chr(10) || 'user:' || d2.b},
                   {'c': d3.c + 6, 'a': 'II' || d3.a, 'b': chr(10) || 'user:' || chr(10) || 'assistant:' || d3.b}])[1],
        list_sort([d1, {'c': d2.c + 3, 'a': 'I' || d2.a, 'b': chr(10) || 'user:' || d2.b},
                   {'c': d3.c + 6, 'a': 'II' || d3.a, 'b': chr(10) || 'user:' || chr(10) || 'assistant:' || d3.b}])[1],
        list_sort([d2, {'c': d3.c + 3, 'a': 'I' || d3.a, 'b': chr(10) || 'assistant:' || d3.b}])[1],
        list_sort([d3, {'c': d2.c + 3, 'a': 'I' || d2.a, 'b': chr(10) || 'user:' || d2.b}])[1]
    FROM (
        SELECT conv_id, rn, list_sort([del0] || CASE WHEN stays THEN [to_u] ELSE [] END
                || CASE WHEN stays AND initial = 's' THEN [{'c': s1.c + extra, 'a': 'K' || s1.a, 'b': own || s1.b}] ELSE [] END
                || CASE WHEN stays AND initial = 'u' THEN [keep_u] ELSE [] END)[1] AS d0,
            list_sort([del1] || CASE WHEN stays THEN [to_u] ELSE [] END || CASE WHEN stays AND initial = 'u' THEN [keep_u] ELSE [] END)[1] AS d1,
            list_sort([del2] || CASE WHEN stays THEN [{'c': s3.c + 3 + extra, 'a': 'R' || s3.a, 'b': chr(10) || 'assistant' || rest || s3.b}] ELSE [] END
                || CASE WHEN stays AND initial = 'a' THEN [{'c': s3.c + extra, 'a': 'K' || s3.a, 'b': own || s3.b}] ELSE [] END)[1] AS d2,
            list_sort([del3] || CASE WHEN stays THEN [to_u] ELSE [] END || CASE WHEN stays AND initial = 'u' THEN [keep_u] ELSE [] END)[1] AS d3
        FROM (
            SELECT j.*, dp.s0, dp.s1, dp.s2, dp.s3, fault NOT IN (1, 2) AS stays, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra,
                   {'c': s0.c + 4, 'a': 'D' || s0.a, 'b': s0.b} AS del0, {'c': s1.c + 4, 'a': 'D' || s1.a, 'b': s1.b} AS del1,
                   {'c': s2.c + 4, 'a': 'D' || s2.a, 'b': s2.b} AS del2, {'c': s3.c + 4, 'a': 'D' || s3.a, 'b': s3.b} AS del3,
                   {'c': s2.c + 3 + CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'a': 'R' || s2.a, 'b': chr(10) || 'user' || rest || s2.b} AS to_u,
                   {'c': s2.c + CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'a': 'K' || s2.a, 'b': own || s2.b} AS keep_u
            FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.rn = dp.rn - 1))),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
           count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
           count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id)
SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(d.s0.c, 0)::BIGINT AS cost,
       coalesce(d.s0.a, '') AS audit, sha256(coalesce(substr(d.s0.b, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
    LEFT JOIN dp d ON d.conv_id IS NOT DISTINCT FROM i.conv_id AND d.rn = 1
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, robbed of their marks, repeated or given to the user, by a hash of conversation and turn."""

    def spaced(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(spaced("role"))
    return (
        conversations.select("*", kind.alias("kind"))
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)))
        .drop("col")
    )


@query("op12_conversation_repair", SQL)
def op12_conversation_repair(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), conversations=rows)
