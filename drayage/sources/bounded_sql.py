"""Read-only SQL text with a row cap."""

from __future__ import annotations

from pyspark.sql import SparkSession

from drayage.sources.files import Preview


def checked_query(spark: SparkSession, text: str) -> str:
    """``text`` if it is one query, else an error.

    Commands run as soon as Spark sees them, so the check comes first: the
    text is placed where the grammar allows nothing but a query.
    """
    statement = text.strip().rstrip(";").strip()
    if not statement.upper().startswith(("SELECT", "WITH")):
        raise ValueError("only SELECT or WITH queries are allowed")
    spark.sql(f"SELECT * FROM (\n{statement}\n) LIMIT 0")
    return statement


def bounded_query(spark: SparkSession, text: str, max_rows: int = 100) -> Preview:
    """At most ``max_rows`` rows of a query."""
    rows = spark.sql(checked_query(spark, text))
    truncated = rows.limit(max_rows + 1).count() > max_rows
    return Preview(rows.limit(max_rows), truncated)
