"""Finds over JSON documents held as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.functions.document_filter import compile_filter


def matches(json_text: Column | str, spec: Mapping[str, object]) -> Column:
    """Whether the document matches; text that is no JSON does not.

    The document is parsed once, however many fields the filter names.
    """
    parsed = F.array(F.try_parse_json(json_text))
    return F.exists(parsed, lambda document: document.isNotNull() & compile_filter(spec, document))


def find(df: DataFrame, json_column: str, spec: Mapping[str, object]) -> DataFrame:
    """The rows whose document matches the filter."""
    return df.filter(matches(json_column, spec))
