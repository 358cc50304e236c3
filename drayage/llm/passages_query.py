from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm.passages import all_spans
from drayage.llm.registry import query
from drayage.plans.registry import Tables


@query("op1_substring_dedup")
def op1_substring_dedup(t: Tables) -> DataFrame:
    spans = all_spans(t.documents)
    return spans.select(
        F.col("key").alias("doc_id"), "start", "length", "n_words", F.col("kept_key").alias("kept_doc_id"), "class_id"
    )
