from __future__ import annotations

from decimal import Decimal as D

import pytest
import shop
from frames import plan, rows
from pyspark.sql import functions as F

from drayage.functions.expressions import catalogue, expr
from drayage.operators import dataflow as flow
from drayage.operators.keys import surrogate_key
from drayage.sources.sinks import write_back


def test_computed_columns_of_the_shop(spark):
    totals = flow.derive(
        shop.orders(spark), {"total_amount": "subtotal + coalesce(tax_amount, 0) - coalesce(discount_amount, 0)"}
    )
    assert [r.total_amount for r in totals.orderBy("order_id").collect()][:2] == [D("1403.9900"), D("2325.9700")]
    names = flow.derive(shop.employees(spark), {"full_name": expr("concat", column1="first_name", separator=" ", column2="last_name")})
    assert names.first().full_name == "John Smith"


def test_derived_columns_survive_the_projection(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    out = flow.Dataflow(source=df, derived={"shout": "upper(name)"}, mapping=[("id", "key")]).run()
    assert out.columns == ["key", "shout"]


def test_select_map_skips_duplicates(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert flow.select_map(df, [("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")]).columns == ["x", "z"]


def test_lookup_takes_one_match_and_keeps_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (None, 1, "n")], "k int, o int, v string")
    assert rows(flow.lookup_first(left, right, ["k"], ["o"], {"v": "found"})) == [(1, "a"), (2, None), (None, None)]


def test_lookup_without_keys_takes_the_first_row(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(9, "z"), (1, "a")], "o int, v string")
    assert rows(flow.lookup_first(left, right, [], ["o"], ["v"])) == [(1, "a"), (2, "a")]
    assert rows(flow.lookup_first(left, right.limit(0), [], ["o"], ["v"])) == [(1, None), (2, None)]


def test_split_streams_partition_the_input(spark):
    df = spark.range(100)
    streams = flow.split_streams(df, {"a": "id % 2 = 0", "b": "id % 3 = 0"}, default="rest")
    counts = {name: s.count() for name, s in streams.items()}
    assert counts == {"a": 50, "b": 17, "rest": 33}
    copied = flow.split(df, {"a": "id % 2 = 0", "b": "id % 3 = 0"}, default="rest", disjoint=True)
    assert copied.groupBy("route").count().filter("route = 'b'").first()["count"] == 34


def test_split_treats_null_as_no_match(spark):
    df = spark.createDataFrame([(None,), (1,)], "v int")
    assert rows(flow.split(df, {"one": "v = 1"}), "v", "route") == [(1, "one"), (None, "default")]


def test_check_violations_ignore_null(spark):
    df = spark.createDataFrame([(1, 7), (2, None), (3, 3)], "id int, rating int")
    assert rows(flow.check_violations(df, {"rating": "rating BETWEEN 1 AND 5"}, ["id"])) == [(1, "rating")]


def test_self_references(spark):
    assert flow.self_fk_orphans(shop.employees(spark), "manager_id", "employee_id").isEmpty()
    broken = shop.categories(spark).filter("category_id <> 6")
    assert rows(flow.self_fk_orphans(broken, "parent_category_id", "category_id"), "category_id") == [(7,), (8,)]


def test_alter_row_precedence(spark):
    df = spark.range(4)
    marked = flow.alter_row(df, insert_if="id >= 0", update_if="id > 0", upsert_if="id > 1", delete_if="id > 2")
    assert rows(marked) == [(0, "insert"), (1, "update"), (2, "upsert"), (3, "delete")]


@pytest.mark.parametrize("start", [1, 100])
def test_surrogate_keys_are_dense(spark, start):
    df = spark.range(1000).select(F.expr("hash(id) % 50").alias("v"), "id")
    keyed = surrogate_key(df, ["v", "id"], "sk", start)
    got = keyed.orderBy("v", "id").collect()
    assert [r.sk for r in got] == list(range(start, start + 1000))


def test_surrogate_keys_with_one_hot_order_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    keyed = surrogate_key(df, ["v"], "sk")
    assert sorted(r.sk for r in keyed.collect()) == list(range(1, 3001))
    assert {r.sk for r in keyed.filter("v = 0").collect()} == set(range(1, 1001))


def test_surrogate_key_descending_and_empty(spark):
    df = spark.range(10)
    assert [r.id for r in surrogate_key(df, [F.desc("id")], "sk").orderBy("sk").collect()] == list(range(9, -1, -1))
    assert surrogate_key(df.limit(0), ["id"], "sk").isEmpty()


def test_dedup_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    text = plan(flow.first_per_key(df, ["k"], ["id"]))
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit")
    assert "Partial" in text


def test_filters_and_columns_reach_the_scan(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    out = flow.Dataflow(
        source=orders, filter="o_orderstatus = 'F'", derived={"p": "upper(o_orderpriority)"}, mapping=[("o_orderkey", "id")]
    ).run()
    text = plan(out)
    assert "EqualTo(o_orderstatus,F)" in text
    assert "o_totalprice" not in text and "o_custkey" not in text


def test_write_back(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert rows(write_back(df, "test")) == [(1, None)]


def test_expression_library():
    assert {p: len(catalogue(p)) for p in ("adf", "pyspark", "powerquery")} == {"adf": 43, "pyspark": 17, "powerquery": 18}
    assert {e.name for e in catalogue(category="null")} == {"coalesce", "iif_null", "is_null"}
    with pytest.raises(KeyError):
        expr("no_such_function")
    with pytest.raises(TypeError):
        expr("surrogate_key")


def test_expression_edge_values(spark):
    df = spark.createDataFrame([("abc", "2.5", None)], "s string, n string, z string")
    got = df.select(
        expr("to_integer", column="s").alias("bad_int"),
        expr("to_double", column="n").alias("double"),
        expr("to_date", column="s", format="yyyy-MM-dd").alias("bad_date"),
        expr("to_timestamp", column="s", format="yyyy").alias("bad_time"),
        expr("concat", column1="s", column2="z", separator="-").alias("null_concat"),
        expr("replace", column="n", old_value=".", new_value=",").alias("literal"),
        expr("left_pad", column="n", length=2, pad_char="0").alias("cut"),
        expr("truncate", column="s", length=500).alias("kept"),
        expr("soundex", column=F.lit("Robert")).alias("code"),
        expr("to_decimal", column=F.lit(123456), precision=4, scale=1).alias("overflow"),
    ).first()
    assert tuple(got) == (None, 2.5, None, None, None, "2,5", "2.", "abc", "R163", None)
