from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm.registry import query
from drayage.llm.topk_search import top_k
from drayage.plans.registry import Tables

SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, v.vec_id,
           coalesce(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_exact_topk_search", SQL)
def op9_exact_topk_search(t: Tables) -> DataFrame:
    return top_k(t.embeddings, F.col("vec_id") % 20 == 0, k=20, scale=64)
