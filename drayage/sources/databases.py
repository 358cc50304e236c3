"""Connections to databases and warehouses through Spark data sources.

Only the options are built here. The drivers and connector jars belong to the
cluster; none of them is used by the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# URL form and driver class per system.
JDBC_URLS = {
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
}
JDBC_PORTS = {"sqlserver": 1433, "postgresql": 5432, "mysql": 3306, "oracle": 1521}
JDBC_DRIVERS = {
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "oracle": "oracle.jdbc.OracleDriver",
}
WAREHOUSE_FORMATS = {"snowflake": "snowflake", "databricks": "databricks", "bigquery": "bigquery"}
DOCUMENT_FORMATS = {"mongodb": "mongodb", "cosmos": "cosmos.oltp"}


def jdbc_options(
    kind: str,
    host: str,
    database: str,
    table: str | None = None,
    query: str | None = None,
    user: str | None = None,
    password: str | None = None,
    port: int | None = None,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Options for one table or one query."""
    if kind not in JDBC_URLS:
        raise ValueError(f"unknown database kind {kind!r}")
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {
        "url": JDBC_URLS[kind].format(host=host, port=port or JDBC_PORTS[kind], database=database),
        "driver": JDBC_DRIVERS[kind],
        "fetchsize": str(fetch_rows),
    }
    options["dbtable" if table else "query"] = table or query
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    return options


def partition_options(column: str, lower: object, upper: object, partitions: int) -> dict[str, str]:
    """Split a table read into ranges of a numeric, date or timestamp column."""
    if partitions < 1:
        raise ValueError("at least one partition")
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, options: dict[str, str], partitioning: dict[str, str] | None = None) -> DataFrame:
    """A table as a DataFrame; Spark pushes filters and columns to the database."""
    return spark.read.format("jdbc").options(**options, **(partitioning or {})).load()


def read_source(spark: SparkSession, kind: str, options: dict[str, str]) -> DataFrame:
    """A warehouse or document store, by the name of its Spark connector."""
    formats = {**WAREHOUSE_FORMATS, **DOCUMENT_FORMATS}
    return spark.read.format(formats.get(kind, kind)).options(**options).load()
