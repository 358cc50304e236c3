from __future__ import annotations

import pytest
from frames import rows

from drayage.functions.type_rules import TYPE_RULES, spark_type
from drayage.operators.mapping import cast_failures, conform, map_columns, map_types

INVENTORY = "column_name string, data_type string, character_maximum_length int, numeric_precision int, numeric_scale int"


def mapped(spark, source, target, *columns):
    df = spark.createDataFrame([("c", *(list(c) + [None] * 4)[:4]) for c in columns], INVENTORY)
    return [r.target_type for r in map_types(df, source, target).collect()]


def test_rule_counts():
    assert sorted(len(v) for v in TYPE_RULES.values()) == [22, 23, 23, 29, 30]


def test_sqlserver_types_keep_their_own_rules_for_postgres(spark):
    assert mapped(spark, "SQL Server", "postgres", ("nvarchar", 50), ("money",), ("datetime2",), ("XML",)) == [
        "varchar(50)",
        "numeric(19,4)",
        "timestamp",
        "xml",
    ]


def test_precision_and_scale_are_kept(spark):
    columns = [("decimal", None, 18, 2), ("decimal",), ("varchar", -1), ("char", 3)]
    assert mapped(spark, "sqlserver", "pg", *columns) == ["numeric(18,2)", "numeric", "varchar", "char(3)"]
    assert mapped(spark, "sqlserver", "snowflake", ("numeric", None, 9, None)) == ["NUMBER(9,0)"]


def test_default_is_a_type_of_the_target(spark):
    for target, default in (("postgresql", "text"), ("snowflake", "VARCHAR"), ("bigquery", "STRING")):
        assert mapped(spark, "sqlserver", target, ("hierarchyid",)) == [default]


def test_unknown_systems_are_refused(spark):
    with pytest.raises(ValueError):
        mapped(spark, "db2", "postgres", ("int",))
    with pytest.raises(ValueError):
        mapped(spark, "oracle", "snowflake", ("number",))


def test_spark_types():
    assert spark_type("sqlserver", "MONEY") == "decimal(19,4)"
    assert spark_type("oracle", "number", 10, 2) == "decimal(10,2)"
    assert spark_type("mysql", "enum") == "string"


COLUMNS = "name string, type string, ordinal int"


def columns(spark, *pairs):
    return spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(pairs)], COLUMNS)


def test_map_columns(spark):
    source = columns(
        spark, ("Id", "int"), ("first_name", "varchar(50)"), ("last_name", "varchar(50)"), ("Note", "text"), ("gone", "int")
    )
    target = columns(spark, ("id", "INT"), ("full_name", "varchar(101)"), ("NOTE", "clob"), ("note", "text"), ("new", "int"))
    transforms = spark.createDataFrame(
        [("full_name", "concat(First_Name, ' ', last_name)")], "target_column string, expression string"
    )
    assert rows(map_columns(source, target, transforms), "kind", "source_column", "target_column") == [
        ("direct", "Id", "id"),
        ("transform", None, "full_name"),
        ("type_cast", "Note", "NOTE"),
        ("unmapped_source", "gone", None),
        ("unmapped_target", None, "new"),
    ]


def test_map_columns_without_transforms(spark):
    source = columns(spark, ("a", "int"))
    assert rows(map_columns(source, source), "kind", "source_column") == [("direct", "a")]


def test_conform_counts_what_it_loses(spark):
    df = spark.createDataFrame([("1", "2024-01-02"), ("x", None), (None, "soon"), ("3000000000", "")], "a string, b string")
    mapping = [("a", "n", "int"), ("b", "day", "date")]
    assert [r.n for r in conform(df, mapping).collect()] == [1, None, None, None]
    assert rows(cast_failures(df, mapping), "source_column", "row_count", "failed_count") == [("a", 4, 2), ("b", 4, 2)]
