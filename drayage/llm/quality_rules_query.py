from __future__ import annotations

from pyspark.sql import DataFrame

from drayage.llm.quality_rules import BASE, judged, learn_rules
from drayage.llm.registry import query
from drayage.plans.registry import Tables


@query("op5_quality_rules")
def op5_quality_rules(t: Tables) -> DataFrame:
    rules = learn_rules(t.documents, t.labels)
    return judged(t.documents.select("doc_id", "text"), rules).select("doc_id", *BASE, "base_failed", "kept")
