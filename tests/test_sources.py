from __future__ import annotations

import json
import os

import pytest
from frames import plan, rows
from pyspark.sql import types as T

from drayage.functions.canonical import canonical_text, row_hash
from drayage.session import drop_scratch, materialise, planned_bytes, shared_root
from drayage.sources import databases, files, inventory, sinks
from drayage.sources.bounded_sql import bounded_query, checked_query


def test_preview_says_whether_more_rows_exist(spark):
    assert not files.preview(spark.range(5), 5).truncated
    more = files.preview(spark.range(6), 5, ["id"], count=True)
    assert (more.truncated, more.total_rows, more.rows.count()) == (True, 6, 5)


def test_bounded_query(spark):
    spark.range(10).createOrReplaceTempView("ten")
    exact = bounded_query(spark, "select * from ten limit 3 ;", 3)
    assert not exact.truncated and exact.rows.count() == 3
    cut = bounded_query(spark, "WITH x AS (SELECT id FROM ten) SELECT * FROM x -- all of them", 4)
    assert cut.truncated and cut.rows.count() == 4


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE ten",
        "INSERT INTO ten VALUES (1)",
        "WITH x AS (SELECT 1 AS id) INSERT INTO ten SELECT * FROM x",
        "SELECT 1; DROP TABLE ten",
        "",
        "SET spark.sql.ansi.enabled=false",
    ],
)
def test_anything_but_a_query_is_refused(spark, text):
    spark.range(10).createOrReplaceTempView("ten")
    with pytest.raises(Exception):  # noqa: B017 - a ValueError or Spark's own parse error
        checked_query(spark, text)


def test_json_lines(spark, tmp_path):
    lines = ['{"a": 1}', "", '{"a": ', '{"a": "x"}', '{"b": 2}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    df = files.read_json_lines(spark, str(tmp_path / "in.json"), "a int")
    assert rows(files.good_lines(df)) == [(1,), (None,)]
    assert rows(files.bad_lines(df)) == [('{"a": "x"}',), ('{"a": ',)]
    assert files.bad_lines(df).count() == 2


def test_json_documents(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    (tmp_path / "object.json").write_text(json.dumps({"a": 3}, indent=1))
    assert rows(files.read_json_documents(spark, str(tmp_path), "a int")) == [(1,), (2,), (3,)]


def test_text_prefix_and_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc\xff\xfedef")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes(b"xy")
    head = files.read_text_prefix(spark, str(tmp_path), 4, glob="*.txt").filter("path LIKE '%a.txt'").first()
    assert head.text == "abc�" and head.truncated
    listed = files.file_inventory(spark, str(tmp_path), glob="*.txt")
    assert rows(listed, "name", "size") == [("a.txt", 8), ("b.txt", 2)]
    assert "content" not in plan(listed.select("name", "size"))
    assert files.file_inventory(spark, str(tmp_path), glob="*.txt", recursive=False).count() == 1


def test_text_prefixes_of_files_with_odd_ends(spark, tmp_path):
    bodies = {
        "ends": b"one\ntwo\n", "open": b"one\ntwo", "blank": b"\n\n", "cr": b"a\r\nb\r\n", "bad": b"ok \xff\xfe\nx",
        "long": b"".join(b"line %d \xc3\xa9\n" % i for i in range(3000)),
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.txt").write_bytes(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits to the long file
    try:
        for most in (1, 9, 20_000, 10**6):
            got = {r["path"].rsplit("/")[-1][:-4]: r for r in files.read_text_prefix(spark, str(tmp_path), most).collect()}
            for name, body in bodies.items():
                assert got[name].text == body[:most].decode("utf-8", "replace"), (name, most)
                assert got[name].truncated == (len(body) > most)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "content" not in plan(files.read_text_prefix(spark, str(tmp_path), 9).select("path", "text"))


def test_jdbc_options():
    options = databases.jdbc_options("postgresql", "host", "db", table="t", user="u", password="p")
    assert options == {
        "url": "jdbc:postgresql://host:5432/db",
        "driver": "org.postgresql.Driver",
        "fetchsize": "10000",
        "dbtable": "t",
        "user": "u",
        "password": "p",
    }
    assert databases.jdbc_options("oracle", "h", "x", query="select 1", port=9)["url"] == "jdbc:oracle:thin:@//h:9/x"
    assert databases.partition_options("id", 0, 100, 8)["numPartitions"] == "8"
    for bad in ({"kind": "db2", "table": "t"}, {"kind": "mysql"}, {"kind": "mysql", "table": "t", "query": "q"}):
        with pytest.raises(ValueError):
            databases.jdbc_options(host="h", database="d", **bad)


def test_schema_gate(spark):
    df = spark.createDataFrame([], "id int, extra string, v int")
    target = T.StructType.fromDDL("ID int, v bigint, need date")
    assert rows(sinks.schema_gate(df, target, allow_drift=True), "column_name", "issue", "passes") == [
        ("extra", "extra", True),
        ("need", "missing", False),
        ("v", "retyped", False),
    ]
    with pytest.raises(ValueError, match="need"):
        sinks.require_schema(df, target, allow_drift=True)
    assert sinks.require_schema(df, T.StructType.fromDDL("id int, v int"), allow_drift=True) is df


def test_create_target_refuses_a_taken_name(spark):
    schema = T.StructType.fromDDL("a int")
    sinks.create_target(spark, "made_once", schema)
    try:
        with pytest.raises(ValueError):
            sinks.create_target(spark, "made_once", schema)
    finally:
        spark.sql("DROP TABLE made_once")


def test_layouts(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert "hashpartitioning(o_custkey" in plan(sinks.layout(orders, "hash", ["o_custkey"], 6))
    assert "RoundRobinPartitioning(3)" in plan(sinks.layout(orders, "ROUND_ROBIN", partitions=3))
    assert "Exchange" not in plan(sinks.layout(orders, "REPLICATE"))  # Spark decides at the join
    with pytest.raises(ValueError):
        sinks.layout(orders, "HASH")


def test_catalog_of_a_database(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("counted")
    try:
        got = rows(inventory.table_inventory(inventory.catalog_tables(spark)))
        assert ("default", "counted", 3) in got
        schemas, tables = inventory.catalog_table_rows(spark)
        counts = dict(rows(inventory.schema_table_counts(schemas, tables)))
        assert counts["default"] >= 1
    finally:
        spark.sql("DROP TABLE counted")


def test_canonical_text(spark):
    df = spark.sql(
        "SELECT 1.5D AS d, cast('NaN' AS double) AS n, 1e300 AS big, timestamp_ntz'2024-01-02 03:04:05' AS t, "
        "X'0aff' AS b, array(1, 2) AS a, cast(NULL AS int) AS z"
    )
    got = df.select(*[canonical_text(df[f.name], f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(got) == ("1.500000", "NaN", "1.0E300", "2024-01-02 03:04:05.000000", "0AFF", "[1,2]", None)
    assert df.select(row_hash([])).first()[0] == 0


def test_sizes_and_shared_folder(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    joined = orders.join(orders.select("o_custkey"), "o_custkey", "left")
    assert planned_bytes(joined) <= 2 * planned_bytes(orders)
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_can_be_dropped(spark):
    other = spark.newSession()
    kept = materialise(other.range(5).toDF("v"), "kept")
    assert kept.count() == 5 and os.path.isdir(f"{shared_root(spark)}/drayage/{spark.sparkContext.applicationId}")
    drop_scratch(spark)
    assert not os.path.exists(f"{shared_root(spark)}/drayage/{spark.sparkContext.applicationId}")


def test_doubles_that_differ_have_different_text(spark):
    df = spark.sql("SELECT explode(array(1e-8D, 9e-8D, 0.1D, 0.1000001D, 0.10000010000000001D, -0.0D, 1e30D)) AS d")
    got = [r[0] for r in df.select(canonical_text(df["d"], df.schema["d"].dataType)).collect()]
    assert got[:3] == ["1.0E-8", "9.0E-8", "0.100000"] and len(set(got)) == 7 - (got[3] == got[4])
