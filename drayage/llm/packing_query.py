from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from drayage.llm.packing import pack
from drayage.llm.registry import query
from drayage.plans.registry import Tables


@query("op10_best_fit_packing")
def op10_best_fit_packing(t: Tables) -> DataFrame:
    return pack(t.documents, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
