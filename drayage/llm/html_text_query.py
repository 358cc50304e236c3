from __future__ import annotations

from pyspark.sql import DataFrame

from drayage.llm.html_text import extract_text
from drayage.llm.registry import query
from drayage.plans.registry import Tables


@query("op3_html_extraction")
def op3_html_extraction(t: Tables) -> DataFrame:
    return extract_text(t.pages)
