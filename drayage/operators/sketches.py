"""Column profiles and exact key counts in a form that can be kept per batch and merged.

A sketch row stands for the values of one column in one batch: what adds up
exactly, a HyperLogLog of the distinct values, the most frequent values and the
quantiles of numbers. Key bitmaps hold whole-number keys exactly, a bit each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.functions.canonical import canonical_text

LOG_REGISTERS = 12  # distinct counts to about 1.6 % (one standard error)
TRACKED = 10_000  # values whose frequency is followed; exact up to three quarters of that many
KLL_SIZE = 400  # ranks of quantiles to about 0.7 %
TOP = 10
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)

KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
BITMAP_BYTES = 4096  # of a bitmap of 32,768 keys


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per column: ``column_name``, what adds up, and three sketches. One pass, no shuffle of values.

    Values are counted in their text form, and quantiles are of numbers only.
    """
    columns = list(columns or df.columns)
    cells = [canonical_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"_c{i}") for i, c in enumerate(columns)]
    numbers = [
        (F.col(f"`{c}`") if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None)).cast("double").alias(f"_x{i}")
        for i, c in enumerate(columns)
    ]
    aggregates, structs = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate(columns):
        cell = F.col(f"_c{i}")
        parts = {
            "value_count": F.count(cell),
            "min_text": F.min(cell),
            "max_text": F.max(cell),
            "max_length": F.max(F.length(cell)),
            "total_length": F.coalesce(F.sum(F.length(cell)), F.lit(0).cast("long")),
            "distinct_sketch": F.hll_sketch_agg(cell, LOG_REGISTERS),
            "top_sketch": F.expr(f"approx_top_k_accumulate(_c{i}, {TRACKED}) FILTER (WHERE _c{i} IS NOT NULL)"),
            "quantile_sketch": F.expr(f"kll_sketch_agg_double(_x{i}, {KLL_SIZE}) FILTER (WHERE NOT isnan(_x{i}))"),
        }
        aggregates += [a.alias(f"_{name}{i}") for name, a in parts.items()]
        structs.append(
            F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("row_count"), *[F.col(f"_{name}{i}").alias(name) for name in parts])
        )
    return df.select(*cells, *numbers).agg(*aggregates).select(F.inline(F.array(*structs)))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of a table from those of its parts."""
    return sketches.groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in ("row_count", "value_count", "total_length")],
        F.min("min_text").alias("min_text"),
        F.max("max_text").alias("max_text"),
        F.max("max_length").alias("max_length"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("top_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def sketched_profile(sketches: DataFrame, top: int = TOP, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """What :func:`column_profile` tells, from sketches, and more: ``top_values`` and ``quantiles``.

    ``top_value`` is the most frequent value, of several as frequent the one
    that sorts first among the ``top`` ones; ``quantiles`` is NULL for columns
    without numbers. ``distinct_count`` and the frequencies of columns with more
    than three quarters of ``TRACKED`` values are estimates.
    """
    found = F.expr(f"approx_top_k_estimate(top_sketch, {top})")
    ordered = F.sort_array(F.transform(found, lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("value"))))
    listed = F.transform(ordered, lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("count")))
    points = F.array(*[F.lit(float(q)) for q in quantiles])
    number = F.when(F.kll_sketch_get_n_double("quantile_sketch") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", points))
    return sketches.withColumn("top_values", listed).select(
        "column_name",
        "value_count",
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"),
        "min_text",
        "max_text",
        "max_length",
        F.when(F.col("value_count") > 0, F.col("total_length") / F.col("value_count")).alias("avg_length"),
        F.get("top_values", F.lit(0))["value"].alias("top_value"),
        F.get("top_values", F.lit(0))["count"].alias("top_count"),
        "top_values",
        number.alias("quantiles"),
    )


def is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, KEY_TYPES)


def key_bitmaps(df: DataFrame, key: str) -> DataFrame:
    """``bucket, bitmap, row_count``: the different values of a whole-number column, a bit each.

    Values are set in bitmaps within a task, so no row per value is shuffled. A
    NULL key has the bucket NULL. Bitmaps of batches merge by :func:`merged_bitmaps`.
    """
    column = F.col(f"`{key}`").cast("long")
    return df.groupBy(F.bitmap_bucket_number(column).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bitmap"), F.count(F.lit(1)).alias("row_count")
    )


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """The bitmaps of a table from those of its parts."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("row_count").alias("row_count"))


def counted_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """One row: ``row_count, distinct_count``, exact; NULL counts as one value."""
    bits = F.when(F.col("bucket").isNull(), F.lit(1).cast("long")).otherwise(F.bitmap_count("bitmap"))
    none = F.lit(0).cast("long")
    return bitmaps.agg(
        F.coalesce(F.sum("row_count"), none).alias("row_count"), F.coalesce(F.sum(bits), none).alias("distinct_count")
    )


def bitmaps_pay(df: DataFrame, key: str) -> bool:
    """Whether the bitmaps that tasks would send are smaller than their keys.

    They are where a task's keys lie close together. Reads the key column
    once; a row per task tells the span of its keys.
    """
    bucket = F.bitmap_bucket_number(F.col(f"`{key}`").cast("long"))
    spans = df.groupBy(F.spark_partition_id()).agg(
        (F.max(bucket) - F.min(bucket) + 1).alias("span"), F.count(F.lit(1)).alias("n")
    )
    sent = spans.agg(F.sum(F.least("span", "n") * BITMAP_BYTES).alias("bitmaps"), F.sum(F.col("n") * 8).alias("keys")).first()
    return sent["bitmaps"] is not None and sent["bitmaps"] <= max(sent["keys"], 1 << 20)


def distinct_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: ``row_count, distinct_count`` of a key, exact, by bitmaps where they are smaller."""
    if len(key) == 1 and is_whole(df, key[0]) and bitmaps_pay(df, key[0]):
        return counted_bitmaps(key_bitmaps(df, key[0]))
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_count"))
