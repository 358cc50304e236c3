from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from drayage.llm.texts import small_batches  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def batches(spark):
    small_batches(spark)


@pytest.fixture(scope="session")
def make(spark):
    """DataFrames of (doc_id, text) rows, in several partitions, with columns whose names clash."""

    def built(rows, extra: bool = False, partitions: int = 3):
        schema = "doc_id long, text string" + (", h long, key string, pos int, n long, id long, a string" if extra else "")
        data = [(*r, None, "k", 1, None, 5, "x") if extra else tuple(r) for r in rows]
        return spark.createDataFrame(data, schema).repartition(partitions)

    return built
