"""Sinks: append, replace, text, new tables, schema gate and layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.session import scratch_path


def append(df: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    """Insert the rows; what is there stays."""
    df.write.mode("append").format(format).options(**options).save(path)


def replace(df: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    """Drop what is there, then insert. ``df`` must not read ``path``."""
    df.write.mode("overwrite").format(format).options(**options).save(path)


def append_jdbc(df: DataFrame, options: dict[str, str], batch_rows: int = 10_000) -> None:
    df.write.format("jdbc").options(**options).option("batchsize", batch_rows).mode("append").save()


def replace_jdbc(df: DataFrame, options: dict[str, str], batch_rows: int = 10_000) -> None:
    """Empty the table without dropping it, then insert."""
    writer = df.write.format("jdbc").options(**options).option("batchsize", batch_rows)
    writer.option("truncate", "true").mode("overwrite").save()


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    """Replace ``path`` with the text lines of ``column``, in parallel parts."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_back(df: DataFrame, label: str) -> DataFrame:
    """Write to a new Parquet table below the shared folder and read it."""
    path = scratch_path(df.sparkSession, label)
    append(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_target(spark: SparkSession, table: str, schema: T.StructType, path: str | None = None) -> DataFrame:
    """A new empty table with ``schema``; fails if the name is taken."""
    if spark.catalog.tableExists(table):
        raise ValueError(f"table {table} already exists")
    options = {"path": path} if path else {}
    return spark.catalog.createTable(table, source="parquet", schema=schema, **options)


def schema_differences(actual: T.StructType, target: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """``(column, issue, actual_type, target_type)`` by case-insensitive name."""
    have = {f.name.lower(): f for f in actual.fields}
    want = {f.name.lower(): f for f in target.fields}
    out = []
    for name, f in want.items():
        if name not in have:
            out.append((f.name, "missing", None, f.dataType.simpleString()))
        elif have[name].dataType != f.dataType:
            out.append((f.name, "retyped", have[name].dataType.simpleString(), f.dataType.simpleString()))
    out += [(f.name, "extra", f.dataType.simpleString(), None) for n, f in have.items() if n not in want]
    return out


def schema_gate(df: DataFrame, target: T.StructType, allow_drift: bool = False) -> DataFrame:
    """The differences between ``df`` and a target schema, as rows.

    ``passes`` tells whether the sink would accept the rows: with drift allowed
    extra columns pass, missing and retyped ones never do.
    """
    rows = [
        (*difference, allow_drift and difference[1] == "extra")
        for difference in schema_differences(df.schema, target)
    ]
    schema = "column_name string, issue string, actual_type string, target_type string, passes boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def require_schema(df: DataFrame, target: T.StructType, allow_drift: bool = False) -> DataFrame:
    """``df`` unchanged, or an error that names every blocking difference."""
    blocking = [d for d in schema_differences(df.schema, target) if not (allow_drift and d[1] == "extra")]
    if blocking:
        raise ValueError(f"schema does not match the target: {blocking}")
    return df


def layout(df: DataFrame, kind: str, keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Physical layout of a table: HASH, ROUND_ROBIN or REPLICATE.

    HASH co-locates equal keys. REPLICATE leaves the rows as they are: whether
    each task that joins them gets a copy is Spark's choice, by their measured
    size.
    """
    kind = kind.upper()
    if kind == "HASH":
        if not keys:
            raise ValueError("HASH needs key columns")
        return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    if kind == "ROUND_ROBIN":
        wanted = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(wanted)
    if kind == "REPLICATE":
        return df
    raise ValueError(f"unknown layout {kind!r}")
