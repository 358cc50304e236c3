from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from drayage.llm.registry import query
from drayage.llm.token_counts import token_counts
from drayage.plans.registry import Tables


@query("op2_token_counts")
def op2_token_counts(t: Tables) -> DataFrame:
    return token_counts(t.documents, public_tokenizers.path("byte_bpe_50k.tiktoken"))
