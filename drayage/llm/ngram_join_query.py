from __future__ import annotations

from pyspark.sql import DataFrame

from drayage.llm.ngram_join import similar_documents
from drayage.llm.registry import query
from drayage.plans.registry import Tables


@query("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(t: Tables) -> DataFrame:
    return similar_documents(t.documents, width=5, percent=75)
