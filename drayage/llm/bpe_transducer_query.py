from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from drayage.llm.bpe_transducer import round_trip
from drayage.llm.registry import query
from drayage.plans.registry import Tables


@query("op13_bpe_transducer")
def op13_bpe_transducer(t: Tables) -> DataFrame:
    return round_trip(t.documents, public_tokenizers.path("byte_bpe_50k.json"))
