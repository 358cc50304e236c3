"""What must hold for the plan of every query, whatever its data."""

from __future__ import annotations

import ast
import pathlib
import re

import pytest
from frames import plan

from drayage.plans.catalog import load_all

QUERIES = load_all()
SOURCE = pathlib.Path(__file__).resolve().parent.parent


# The query "layout" asks for a broadcast of a table whose size it checks.
@pytest.mark.parametrize("name", [n for n in QUERIES if n != "layout"])
def test_no_pairs_of_all_rows_and_no_window_in_one_task(spark, folder, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too big to broadcast
    try:
        text = plan(QUERIES[name].run(spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window \[[^\n]*\n[^\n]*(Sort[^\n]*\n[^\n]*)?Exchange SinglePartition", text)
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_sources_avoid_what_does_not_scale():
    for path in (SOURCE / "drayage").rglob("*.py"):
        tree = ast.parse(path.read_text())
        called = {n.func.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
        assert not called & {"localCheckpoint", "crossJoin", "toPandas", "udf", "pandas_udf", "applyInPandas"}, path
