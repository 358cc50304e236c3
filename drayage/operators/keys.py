"""Dense surrogate keys without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drayage.operators.ordering import PART, POSITION, in_order
from drayage.session import materialise


def surrogate_key(
    df: DataFrame,
    order_by: Sequence[Column | str],
    name: str = "surrogate_key",
    start_at: int = 1,
) -> DataFrame:
    """Number rows ``start_at``, ``start_at + 1``, … in ``order_by`` order.

    Rows equal in ``order_by`` may be numbered either way. The key of a row is
    the rows in earlier partitions plus its position. All of ``df`` is written
    once, so leave out what is not needed before.
    """
    columns = df.columns
    written = in_order(df, order_by, "surrogate-key")
    sizes = written.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # one small row per partition
    starts = sizes.select(PART, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + start_at).alias("_start"))
    return written.join(materialise(starts, "key-starts"), PART).select(
        *[f"`{c}`" for c in columns], (F.col("_start") + F.col(POSITION)).alias(name)
    )
