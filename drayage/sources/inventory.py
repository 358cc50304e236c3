"""What a source holds: tables, columns and schemas as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.operators.reconcile import table_counts

INVENTORY_SCHEMA = (
    "table_name string, ordinal int, column_name string, data_type string, "
    "numeric_precision int, numeric_scale int, is_nullable boolean"
)

# Schemas that belong to the system, not to its users.
SYSTEM_SCHEMAS = (
    "information_schema",
    "mysql",
    "performance_schema",
    "pg_catalog",
    "pg_toast",
    "sys",
)


def column_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column, in order: type, precision and nullability."""
    rows = []
    for name, df in tables.items():
        for i, f in enumerate(df.schema.fields, start=1):
            decimal = isinstance(f.dataType, T.DecimalType)
            rows.append(
                (
                    name,
                    i,
                    f.name,
                    f.dataType.simpleString(),
                    f.dataType.precision if decimal else None,
                    f.dataType.scale if decimal else None,
                    f.nullable,
                )
            )
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, INVENTORY_SCHEMA)


def measured_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """:func:`column_inventory` with the row and NULL counts of each column."""
    from drayage.operators.quality import null_profile

    counts = None
    for name, df in tables.items():
        part = null_profile(df).select(F.lit(name).alias("table_name"), "column_name", "row_count", "null_count")
        counts = part if counts is None else counts.unionAll(part)
    return column_inventory(tables).join(counts, ["table_name", "column_name"])


def table_inventory(tables: Mapping[str, DataFrame], schema: str = "default") -> DataFrame:
    """``schema_name, table_name, row_count``, counted exactly."""
    return table_counts(tables).select(F.lit(schema).alias("schema_name"), "table_name", "row_count")


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """The permanent tables of a database by name."""
    name = database or spark.catalog.currentDatabase()
    return {
        table.name: spark.table(f"`{name}`.`{table.name}`")
        for table in spark.catalog.listTables(name)
        if not table.isTemporary
    }


def catalog_table_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``schema_name`` of every database and ``schema_name, table_name``."""
    databases = [d.name for d in spark.catalog.listDatabases()]
    tables = [(d, x.name) for d in databases for x in spark.catalog.listTables(d) if not x.isTemporary]
    return (
        spark.createDataFrame([(d,) for d in databases], "schema_name string"),
        spark.createDataFrame(tables, "schema_name string, table_name string"),
    )


def schema_table_counts(
    schemas: DataFrame, tables: DataFrame, exclude: Sequence[str] = SYSTEM_SCHEMAS
) -> DataFrame:
    """Tables per schema, 0 for an empty one, without the system schemas.

    Tables are counted before the join, so a schema that holds a third of all
    tables reaches it as one row.
    """
    counts = tables.groupBy("schema_name").agg(F.count("table_name").alias("table_count"))
    wanted = schemas.filter(~F.lower("schema_name").isin(*exclude))
    return wanted.join(counts, "schema_name", "left").fillna(0, ["table_count"])
