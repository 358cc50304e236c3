"""Rows and plans of DataFrames, as the tests of both folders read them."""

from __future__ import annotations


def rows(df, *order: str) -> list[tuple]:
    """Rows as sorted tuples, columns in the given order."""
    selected = df.select(*order) if order else df
    return sorted((tuple(r) for r in selected.collect()), key=repr)


def plan(df) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
