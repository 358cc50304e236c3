"""Column type rules between database systems.

The dictionaries are fixed values: the target spelling of each source type.
"""

from __future__ import annotations

SQLSERVER, MYSQL, ORACLE = "sqlserver", "mysql", "oracle"
POSTGRES, SNOWFLAKE, BIGQUERY = "postgresql", "snowflake", "bigquery"

# Source type -> target type, per pair of systems.
TYPE_RULES: dict[tuple[str, str], dict[str, str]] = {
    (SQLSERVER, POSTGRES): {
        "int": "integer",
        "bigint": "bigint",
        "smallint": "smallint",
        "tinyint": "smallint",
        "bit": "boolean",
        "decimal": "numeric",
        "numeric": "numeric",
        "money": "numeric(19,4)",
        "smallmoney": "numeric(10,4)",
        "float": "double precision",
        "real": "real",
        "datetime": "timestamp",
        "datetime2": "timestamp",
        "smalldatetime": "timestamp",
        "date": "date",
        "time": "time",
        "datetimeoffset": "timestamptz",
        "char": "char",
        "varchar": "varchar",
        "nchar": "char",
        "nvarchar": "varchar",
        "text": "text",
        "ntext": "text",
        "binary": "bytea",
        "varbinary": "bytea",
        "image": "bytea",
        "uniqueidentifier": "uuid",
        "xml": "xml",
        "sql_variant": "text",
    },
    (MYSQL, POSTGRES): {
        "int": "integer",
        "bigint": "bigint",
        "smallint": "smallint",
        "tinyint": "smallint",
        "mediumint": "integer",
        "decimal": "numeric",
        "numeric": "numeric",
        "float": "real",
        "double": "double precision",
        "datetime": "timestamp",
        "timestamp": "timestamptz",
        "date": "date",
        "time": "time",
        "year": "smallint",
        "char": "char",
        "varchar": "varchar",
        "tinytext": "text",
        "text": "text",
        "mediumtext": "text",
        "longtext": "text",
        "tinyblob": "bytea",
        "blob": "bytea",
        "mediumblob": "bytea",
        "longblob": "bytea",
        "binary": "bytea",
        "varbinary": "bytea",
        "enum": "varchar(255)",
        "set": "varchar(255)",
        "json": "jsonb",
        "bit": "boolean",
    },
    (ORACLE, POSTGRES): {
        "number": "numeric",
        "float": "double precision",
        "binary_float": "real",
        "binary_double": "double precision",
        "varchar2": "varchar",
        "nvarchar2": "varchar",
        "char": "char",
        "nchar": "char",
        "clob": "text",
        "nclob": "text",
        "blob": "bytea",
        "date": "timestamp",
        "timestamp": "timestamp",
        "timestamp with time zone": "timestamptz",
        "timestamp with local time zone": "timestamptz",
        "raw": "bytea",
        "long": "text",
        "long raw": "bytea",
        "xmltype": "xml",
        "rowid": "varchar(18)",
        "interval year to month": "interval",
        "interval day to second": "interval",
    },
    (SQLSERVER, SNOWFLAKE): {
        "int": "NUMBER(38,0)",
        "bigint": "NUMBER(38,0)",
        "smallint": "NUMBER(38,0)",
        "tinyint": "NUMBER(38,0)",
        "bit": "BOOLEAN",
        "decimal": "NUMBER",
        "numeric": "NUMBER",
        "float": "FLOAT",
        "real": "FLOAT",
        "datetime": "TIMESTAMP_NTZ",
        "datetime2": "TIMESTAMP_NTZ",
        "date": "DATE",
        "time": "TIME",
        "datetimeoffset": "TIMESTAMP_TZ",
        "char": "VARCHAR",
        "varchar": "VARCHAR",
        "nvarchar": "VARCHAR",
        "text": "VARCHAR",
        "ntext": "VARCHAR",
        "binary": "BINARY",
        "varbinary": "BINARY",
        "uniqueidentifier": "VARCHAR(36)",
        "xml": "VARIANT",
    },
    (SQLSERVER, BIGQUERY): {
        "int": "INT64",
        "bigint": "INT64",
        "smallint": "INT64",
        "tinyint": "INT64",
        "bit": "BOOL",
        "decimal": "NUMERIC",
        "numeric": "NUMERIC",
        "float": "FLOAT64",
        "real": "FLOAT64",
        "datetime": "DATETIME",
        "datetime2": "DATETIME",
        "date": "DATE",
        "time": "TIME",
        "datetimeoffset": "TIMESTAMP",
        "char": "STRING",
        "varchar": "STRING",
        "nvarchar": "STRING",
        "text": "STRING",
        "ntext": "STRING",
        "binary": "BYTES",
        "varbinary": "BYTES",
        "uniqueidentifier": "STRING",
        "xml": "STRING",
    },
}

# The type for anything without a rule.
DEFAULT_TYPE = {POSTGRES: "text", SNOWFLAKE: "VARCHAR", BIGQUERY: "STRING"}

# Target types that take the source's length, and its precision and scale.
SIZED_TYPES = ("char", "varchar", "VARCHAR")
SCALED_TYPES = ("numeric", "NUMBER", "NUMERIC")

SYSTEM_NAMES = {
    "sqlserver": SQLSERVER,
    "sql server": SQLSERVER,
    "mssql": SQLSERVER,
    "azure sql": SQLSERVER,
    "synapse": SQLSERVER,
    "fabric": SQLSERVER,
    "mysql": MYSQL,
    "oracle": ORACLE,
    "postgres": POSTGRES,
    "postgresql": POSTGRES,
    "pg": POSTGRES,
    "snowflake": SNOWFLAKE,
    "bigquery": BIGQUERY,
    "bq": BIGQUERY,
}


def system(name: str) -> str:
    try:
        return SYSTEM_NAMES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown system {name!r}") from None


# The Spark type that holds a source type's values.
SPARK_TYPES: dict[str, dict[str, str]] = {
    SQLSERVER: {
        "int": "int",
        "bigint": "bigint",
        "smallint": "smallint",
        "tinyint": "smallint",
        "bit": "boolean",
        "decimal": "decimal",
        "numeric": "decimal",
        "money": "decimal(19,4)",
        "smallmoney": "decimal(10,4)",
        "float": "double",
        "real": "float",
        "datetime": "timestamp_ntz",
        "datetime2": "timestamp_ntz",
        "smalldatetime": "timestamp_ntz",
        "date": "date",
        "datetimeoffset": "timestamp",
        "binary": "binary",
        "varbinary": "binary",
        "image": "binary",
    },
    MYSQL: {
        "int": "int",
        "bigint": "bigint",
        "smallint": "smallint",
        "tinyint": "smallint",
        "mediumint": "int",
        "decimal": "decimal",
        "numeric": "decimal",
        "float": "float",
        "double": "double",
        "datetime": "timestamp_ntz",
        "timestamp": "timestamp",
        "date": "date",
        "year": "smallint",
        "tinyblob": "binary",
        "blob": "binary",
        "mediumblob": "binary",
        "longblob": "binary",
        "binary": "binary",
        "varbinary": "binary",
        "bit": "boolean",
    },
    ORACLE: {
        "number": "decimal",
        "float": "double",
        "binary_float": "float",
        "binary_double": "double",
        "blob": "binary",
        "date": "timestamp_ntz",
        "timestamp": "timestamp_ntz",
        "timestamp with time zone": "timestamp",
        "timestamp with local time zone": "timestamp",
        "raw": "binary",
        "long raw": "binary",
        "interval year to month": "interval year to month",
        "interval day to second": "interval day to second",
    },
}


def spark_type(source: str, data_type: str, precision: int | None = None, scale: int | None = None) -> str:
    """The Spark type for a source column; text types and the rest are string."""
    found = SPARK_TYPES.get(system(source), {}).get(data_type.strip().lower(), "string")
    if found == "decimal":
        return f"decimal({precision or 38},{scale or 0})"
    return found
