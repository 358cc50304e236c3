"""Type and column mapping over inventories read from the part table, and
casts of order data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.functions.type_rules import MYSQL, POSTGRES, SNOWFLAKE, SQLSERVER, TYPE_RULES
from drayage.operators.mapping import cast_failures, conform, map_columns, map_types, mapping_summary
from drayage.plans.registry import Tables, query


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sized_columns(t: Tables, types: list[str]) -> DataFrame:
    """A column inventory with one row per part; types cycle by part key."""
    names = F.array(*[F.lit(x) for x in types])
    return t.part.select(
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column_name"),
        F.element_at(names, (F.col("p_partkey") % len(types) + 1).cast("int")).alias("data_type"),
        F.expr("if(p_partkey % 3 = 0, NULL, p_size)").alias("character_maximum_length"),
        F.expr("if(p_partkey % 4 = 0, NULL, p_size % 20 + 5)").alias("numeric_precision"),
        F.expr("if(p_partkey % 4 = 0, NULL, p_size % 4)").alias("numeric_scale"),
    )


def type_mapping_sql(source: str, target: str, types: list[str], default: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in TYPE_RULES[(source, target)].items())
    return f"""
    WITH inventory AS (
        SELECT 'c' || p_partkey::VARCHAR AS column_name,
               ([{quoted(types)}])[(p_partkey % {len(types)} + 1)::INTEGER] AS data_type,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS character_maximum_length,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size % 20 + 5 END AS numeric_precision,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size % 4 END AS numeric_scale
        FROM part
    ), mapped AS (
        SELECT *, CASE lower(data_type) {cases} ELSE '{default}' END AS m FROM inventory
    )
    SELECT column_name, data_type, character_maximum_length, numeric_precision, numeric_scale,
           CASE WHEN m IN ('char', 'varchar', 'VARCHAR') AND character_maximum_length > 0
                THEN m || '(' || character_maximum_length || ')'
                WHEN m IN ('numeric', 'NUMBER', 'NUMERIC') AND numeric_precision > 0
                THEN m || '(' || numeric_precision || ',' || coalesce(numeric_scale, 0) || ')'
                ELSE m END AS target_type
    FROM mapped
    """


SQLSERVER_TYPES = [*TYPE_RULES[(SQLSERVER, POSTGRES)], "NVARCHAR", "geography"]
MYSQL_TYPES = [*TYPE_RULES[(MYSQL, POSTGRES)], "VARCHAR", "point"]


@query("type_mapping", type_mapping_sql(SQLSERVER, POSTGRES, SQLSERVER_TYPES, "text"))
def type_mapping(t: Tables) -> DataFrame:
    return map_types(sized_columns(t, SQLSERVER_TYPES), "SQL Server", "PostgreSQL")


@query("type_mapping_mysql", type_mapping_sql(MYSQL, POSTGRES, MYSQL_TYPES, "text"))
def type_mapping_mysql(t: Tables) -> DataFrame:
    return map_types(sized_columns(t, MYSQL_TYPES), "mysql", "postgres")


@query("type_mapping_snowflake", type_mapping_sql(SQLSERVER, SNOWFLAKE, SQLSERVER_TYPES, "VARCHAR"))
def type_mapping_snowflake(t: Tables) -> DataFrame:
    return map_types(sized_columns(t, SQLSERVER_TYPES), "sqlserver", "snowflake")


COLUMN_MAPPING = """
    WITH source AS (
        SELECT p_brand AS table_name, 'Col_' || p_partkey AS name, p_type AS type FROM part
    ), target AS (
        SELECT p_brand AS table_name, 'COL_' || p_partkey AS name,
               CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE lower(p_type) END AS type
        FROM part WHERE p_partkey % 7 <> 0
        UNION ALL SELECT p_brand, 'new_' || p_partkey, p_type FROM part WHERE p_partkey % 11 = 0
    ), transforms AS (
        SELECT p_brand AS table_name, 'col_' || p_partkey AS target_column,
               'concat(Col_' || p_partkey || ', col_' || (p_partkey + 25) || ')' AS expression,
               p_partkey AS a, p_partkey + 25 AS b
        FROM part WHERE p_partkey % 13 = 0
    ), used AS (
        SELECT table_name, 'col_' || a AS name FROM transforms UNION SELECT table_name, 'col_' || b FROM transforms
    ), paired AS (
        SELECT s.table_name, s.name AS source_column, s.type AS source_type, t.name AS target_column,
               t.type AS target_type, t.name IS NOT NULL AND x.target_column IS NULL AS is_direct,
               u.name IS NOT NULL AS is_used
        FROM source s
        LEFT JOIN target t ON s.table_name = t.table_name AND lower(s.name) = lower(t.name)
        LEFT JOIN transforms x ON s.table_name = x.table_name AND lower(s.name) = x.target_column
        LEFT JOIN used u ON s.table_name = u.table_name AND lower(s.name) = u.name
    )
    SELECT table_name, CASE WHEN lower(source_type) = lower(target_type) THEN 'direct' ELSE 'type_cast' END AS kind,
           source_column, source_type, target_column, target_type, NULL::VARCHAR AS expression
    FROM paired WHERE is_direct
    UNION ALL
    SELECT table_name, 'unmapped_source', source_column, source_type, NULL, NULL, NULL
    FROM paired WHERE NOT is_direct AND NOT is_used
    UNION ALL
    SELECT table_name, 'transform', NULL, NULL, target_column, NULL, expression FROM transforms
    UNION ALL
    SELECT table_name, 'unmapped_target', NULL, NULL, name, type, NULL FROM target t
    WHERE NOT EXISTS (SELECT 1 FROM source s WHERE s.table_name = t.table_name AND lower(s.name) = lower(t.name))
      AND NOT EXISTS (SELECT 1 FROM transforms x WHERE x.table_name = t.table_name AND x.target_column = lower(t.name))
"""


@query("column_mapping", COLUMN_MAPPING)
def column_mapping(t: Tables) -> DataFrame:
    source = t.part.selectExpr(
        "p_brand AS table_name", "concat('Col_', p_partkey) AS name", "p_type AS type", "p_partkey AS ordinal"
    )
    target = (
        t.part.filter("p_partkey % 7 <> 0")
        .selectExpr(
            "p_brand AS table_name",
            "concat('COL_', p_partkey) AS name",
            "if(p_partkey % 5 = 0, 'other', lower(p_type)) AS type",
            "p_partkey AS ordinal",
        )
        .unionAll(
            t.part.filter("p_partkey % 11 = 0").selectExpr(
                "p_brand", "concat('new_', p_partkey)", "p_type", "p_partkey"
            )
        )
    )
    transforms = t.part.filter("p_partkey % 13 = 0").selectExpr(
        "p_brand AS table_name",
        "concat('col_', p_partkey) AS target_column",
        "concat('concat(Col_', p_partkey, ', col_', p_partkey + 25, ')') AS expression",
    )
    return map_columns(source, target, transforms, by=["table_name"])


@query(
    "mapping_summary",
    f"""
    SELECT table_name, count(*) FILTER (kind = 'direct') AS direct, count(*) FILTER (kind = 'type_cast') AS type_cast,
           count(*) FILTER (kind = 'transform') AS transform, count(*) FILTER (kind = 'unmapped_source') AS unmapped_source,
           count(*) FILTER (kind = 'unmapped_target') AS unmapped_target
    FROM ({COLUMN_MAPPING}) GROUP BY table_name
    """,
)
def mapping_summary_query(t: Tables) -> DataFrame:
    return mapping_summary(column_mapping(t), by=["table_name"])


ORDER_CASTS = [
    ("priority_code", "priority_code", "int"),
    ("o_orderstatus", "is_final", "boolean"),
    ("o_totalprice", "price_cents", "decimal(7,2)"),
    ("date_text", "order_date", "date"),
]


def cast_source(t: Tables) -> DataFrame:
    """Orders as text columns, some of which do not fit their target type."""
    return t.spread("orders").selectExpr(
        "o_orderkey",
        "substring(o_orderpriority, 1, cast(1 + o_orderkey % 2 AS int)) AS priority_code",
        "o_orderstatus",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS o_totalprice",
        "if(o_orderkey % 7 = 0, 'unknown', date_format(o_orderdate, 'yyyy-MM-dd')) AS date_text",
    )


CAST_SQL = """
    WITH casts AS (
        SELECT o_orderkey, substring(o_orderpriority, 1, (1 + o_orderkey % 2)::INTEGER) AS priority_code, o_orderstatus,
               o_totalprice::DECIMAL(18,2)::VARCHAR AS o_totalprice,
               CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text
        FROM orders
    ), conformed AS (
        SELECT o_orderkey, TRY_CAST(priority_code AS INTEGER) AS priority_code,
               CASE o_orderstatus WHEN 'F' THEN FALSE END AS is_final,
               CASE WHEN o_totalprice::DECIMAL(18,2) < 100000 THEN o_totalprice::DECIMAL(18,2)::DECIMAL(7,2) END
                   AS price_cents,
               TRY_CAST(date_text AS DATE) AS order_date
        FROM casts
    )
"""


@query("conform_cast", CAST_SQL + "SELECT * FROM conformed")
def conform_cast(t: Tables) -> DataFrame:
    return conform(cast_source(t), [("o_orderkey", "o_orderkey", "bigint"), *ORDER_CASTS])


@query(
    "cast_failures",
    CAST_SQL
    + """
    SELECT 'priority_code' AS source_column, 'priority_code' AS target_column, 'int' AS target_type,
           count(*) AS row_count, count(*) FILTER (priority_code IS NULL) AS failed_count FROM conformed
    UNION ALL SELECT 'o_orderstatus', 'is_final', 'boolean', count(*), count(*) FILTER (is_final IS NULL) FROM conformed
    UNION ALL SELECT 'o_totalprice', 'price_cents', 'decimal(7,2)', count(*),
                     count(*) FILTER (price_cents IS NULL) FROM conformed
    UNION ALL SELECT 'date_text', 'order_date', 'date', count(*), count(*) FILTER (order_date IS NULL) FROM conformed
    """,
)
def cast_failures_query(t: Tables) -> DataFrame:
    return cast_failures(cast_source(t), ORDER_CASTS)
