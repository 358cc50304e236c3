from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from drayage.llm.piece_sampling import sampled_segmentations
from drayage.llm.registry import query
from drayage.plans.registry import Tables


@query("op7_sentencepiece_sampling")
def op7_sentencepiece_sampling(t: Tables) -> DataFrame:
    return sampled_segmentations(t.documents, public_tokenizers.path("piece_bpe_32k.model"), k=2)
