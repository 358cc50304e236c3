"""One text form per type, and row hashes built on it.

Reconciliation compares cells as text, so both sides of a migration must print
a value the same way whatever type it landed in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE_SCALE = 6
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def canonical_text(column: Column, data_type: T.DataType) -> Column:
    """``column`` as text: plain decimals, fixed timestamps, NULL stays NULL.

    Different doubles have different texts: what six decimals cannot hold
    exactly is printed in full.
    """
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        as_decimal = column.try_cast(T.DecimalType(38, DOUBLE_SCALE))
        exact = as_decimal.cast(data_type) == column
        return F.when(exact, as_decimal.cast("string")).otherwise(column.cast("string"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, TIMESTAMP_FORMAT)
    if isinstance(data_type, T.BinaryType):
        return F.hex(column)
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def text_cells(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The canonical text of ``columns``, each under its own name."""
    return [canonical_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in columns]


def raw_cells(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """``columns`` as they are, maps and the like as text, ready to hash.

    Equal values of one type have equal text, so a hash of raw cells can stand
    in for a hash of text cells where both sides have the same type.
    """
    return [raw_cell(c, df.schema[c].dataType) for c in columns]


def raw_cell(column: str, data_type: T.DataType) -> Column:
    value = F.col(f"`{column}`")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return value + F.lit(0).cast(data_type)  # -0.0 is 0.0
    return value if is_hashable(data_type) else canonical_text(value, data_type)


def is_hashable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return is_hashable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(is_hashable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def row_hash(cells: Sequence[Column]) -> Column:
    """64-bit hash of a row of cells.

    The null pattern is hashed with the values: a plain ``xxhash64`` skips
    NULLs, so (NULL, 'a') and ('a', NULL) would look alike.
    """
    if not cells:
        return F.lit(0).cast("long")
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cells])
    return F.xxhash64(nulls, *cells)
