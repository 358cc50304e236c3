"""Places of rows within their group, where a group may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayage.operators.ordering import PART, POSITION
from drayage.session import materialise


def same(a: str, b: str, column: str) -> Column:
    """Equal, or null on both sides."""
    return F.col(f"{a}.{column}").eqNullSafe(F.col(f"{b}.{column}"))


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """Rows written in the order of ``grp`` first: the place in the group as ``pos`` and the group's ``total``.

    ``rows`` comes from ``in_order``. A group may span partitions, so no group
    has to fit one task. What is handed over is a count per partition and group in it.
    """
    counts = rows.groupBy(PART, "grp").agg(F.count(F.lit(1)).alias("n"), F.min(POSITION).alias("first"))
    earlier = Window.partitionBy("grp").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    spans = materialise(
        counts.select(
            PART, "grp", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(Window.partitionBy("grp")).alias("total"),
        ),
        label,
    )
    on = same("r", "s", "grp") & (F.col(f"r.{PART}") == F.col(f"s.{PART}"))
    kept = [f"r.{c}" for c in rows.columns if c not in (PART, POSITION)]
    return rows.alias("r").join(spans.alias("s"), on).select(*kept, (F.col(POSITION) + F.col("shift")).alias("pos"), "total")
