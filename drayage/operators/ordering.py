"""Ordered work that stays balanced whatever the keys look like.

A window per key puts a hot key into one task. Here rows are put in order by a
range shuffle and written with their partition and their position in it; the
window then runs per range partition, and the rows at the borders, one per
partition, are handed over by a window of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drayage.session import materialise

# monotonically_increasing_id() is (partition << 33) + position in partition.
POSITION_BITS = 33
PART, POSITION = "_part", "_pos"

def in_order(df: DataFrame, order_by: Sequence[Column | str], label: str) -> DataFrame:
    """``df`` written in order, with ``_part`` and ``_pos``.

    ``_part`` ascends with the order and ``_pos`` counts from 0 within it. A row
    sequence breaks ties, so that many rows with one order value still spread
    over partitions.
    """
    columns = df.columns
    order = [F.col(o) if isinstance(o, str) else o for o in order_by] + [F.col("_seq")]
    sequenced = df.withColumn("_seq", F.monotonically_increasing_id())
    ordered = sequenced.repartitionByRange(*order).sortWithinPartitions(*order)
    row_id = F.monotonically_increasing_id()
    numbered = ordered.select(
        *[f"`{c}`" for c in columns],
        F.shiftright(row_id, POSITION_BITS).cast("int").alias(PART),
        row_id.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias(POSITION),
    )
    return materialise(numbered, label)


def neighbour(
    ordered: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    previous: bool,
    found: str,
    marked: Column | None = None,
) -> DataFrame:
    """Add columns of the nearest previous or next row with the same keys.

    ``ordered`` comes from :func:`in_order` sorted by the keys first, possibly
    filtered since. ``columns`` maps column names to the names to add; they are
    NULL, and ``found`` is false, where there is no such row. With ``marked``
    only the rows it holds for count as previous rows.

    What a range partition needs of those before (or after) it is one row: a
    window over one small row per partition finds it.
    """
    wanted = list(dict.fromkeys([*keys, *columns]))
    row, place = F.struct(*wanted), F.col(POSITION)
    window, parts = W.partitionBy(PART).orderBy(POSITION), W.orderBy(PART)
    earlier = (W.unboundedPreceding, -1)
    if marked is not None:
        row, place = F.when(marked, row), F.when(marked, place)
        inside = F.last(row, True).over(window.rowsBetween(*earlier))
    else:
        inside = F.lag(row).over(window) if previous else F.lead(row).over(window)
    edges = ordered.groupBy(PART).agg((F.max_by(row, place) if previous else F.min_by(row, place)).alias("_edge"))
    handed = F.last("_edge", True).over(parts.rowsBetween(*earlier)) if previous else F.lead("_edge").over(parts)
    borders = materialise(edges.select(PART, handed.alias("_edge")), "borders")
    # A written partition goes to one task again; several may share one.
    joined = ordered.withColumn("_inside", inside).join(borders, PART, "left")
    other = F.coalesce("_inside", "_edge")
    same = other.isNotNull()
    for k in keys:
        same = same & other.getField(k).eqNullSafe(F.col(k))
    out = joined.withColumn("_same", same).withColumn("_other", other)
    return out.withColumns(
        {
            **{name: F.when(F.col("_same"), F.col("_other").getField(c)) for c, name in columns.items()},
            found: F.col("_same"),
        }
    ).drop("_inside", "_edge", "_same", "_other")
