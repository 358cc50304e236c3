from __future__ import annotations

from decimal import Decimal as D

import shop
import pytest
from frames import plan, rows
from pyspark.sql import functions as F

from drayage.operators import reconcile as reconciling
from drayage.operators.reconcile import count_compare, reconcile


def test_a_table_equals_itself(spark):
    orders = shop.orders(spark)
    result = reconcile(orders, orders, ["order_id"])
    assert result.states.isEmpty()
    assert result.mismatches().isEmpty()
    assert result.summary().first().asDict() == {
        "source_count": 6,
        "target_count": 6,
        "missing_in_target": 0,
        "extra_in_target": 0,
        "duplicate_source_keys": 0,
        "duplicate_target_keys": 0,
        "differing_keys": 0,
        "value_mismatches": 0,
        "unmatched_rows": 0,
    }


def test_computed_values_that_were_stored_rounded(spark):
    """522.4905 against a stored 522.49: compared as text of the number."""
    items = shop.order_items(spark)
    total = F.expr("quantity * unit_price * (1 - coalesce(discount_pct, 0) / 100)")
    source = items.withColumn("line_total", total.cast("decimal(19,4)"))
    target = items.withColumn("line_total", F.round(total, 2).cast("decimal(19,4)"))
    result = reconcile(source, target, ["order_id", "line_number"], ["line_total"])
    assert rows(result.mismatches()) == [
        (10003, 1, "line_total", "522.4905", "522.4900"),
        (10004, 2, "line_total", "314.9910", "314.9900"),
    ]


def test_column_absent_in_target_counts_as_empty_text(spark):
    source = spark.createDataFrame([(1, "a"), (2, "")], "id int, note string")
    target = source.select("id")
    assert rows(reconcile(source, target, ["id"]).mismatches()) == [(1, "note", "a", "")]


def test_composite_keys_do_not_run_together(spark):
    source = spark.createDataFrame([("a|b", "c", 1)], "k1 string, k2 string, v int")
    target = spark.createDataFrame([("a", "b|c", 1)], "k1 string, k2 string, v int")
    result = reconcile(source, target, ["k1", "k2"])
    assert rows(result.missing()) == [("a|b", "c")]
    assert rows(result.extra()) == [("a", "b|c")]


def test_null_differs_from_the_text_none(spark):
    source = spark.createDataFrame([(1, None), (None, "x")], "id int, v string")
    target = spark.createDataFrame([(1, "None"), (None, "x")], "id int, v string")
    assert rows(reconcile(source, target, ["id"]).mismatches()) == [(1, "v", None, "None")]


def test_nulls_in_different_columns_do_not_hash_alike(spark):
    source = spark.createDataFrame([(1, None, "x")], "id int, a string, b string")
    target = spark.createDataFrame([(1, "x", None)], "id int, a string, b string")
    assert rows(reconcile(source, target, ["id"]).mismatches()) == [(1, "a", None, "x"), (1, "b", "x", None)]


def test_types_may_differ_between_the_sides(spark):
    source = spark.createDataFrame([(1, D("5.50"))], "id int, v decimal(10,2)")
    target = spark.createDataFrame([(1, D("5.500000"))], "id bigint, v decimal(12,6)")
    assert rows(reconcile(source, target, ["id"]).mismatches()) == [(1, "v", "5.50", "5.500000")]
    double = spark.createDataFrame([(1, 5.5)], "id bigint, v double")
    assert reconcile(target, double, ["id"]).mismatches().isEmpty()


def test_duplicate_keys_are_reported_and_compared_once(spark):
    source = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], "id int, v string")
    target = spark.createDataFrame([(1, "b"), (1, "c"), (2, "x")], "id int, v string")
    result = reconcile(source, target, ["id"])
    assert rows(result.duplicates()) == [(1, 2, 2)]
    assert rows(result.mismatches()) == [(1, "v", "a", "c")]  # b is on both sides
    same = reconcile(source, source, ["id"])
    assert rows(same.duplicates()) == [(1, 2, 2)] and same.mismatches().isEmpty()


def test_rows_of_one_key_are_compared_as_multisets(spark):
    source = spark.createDataFrame([(1, "p"), (1, "q"), (2, "a"), (2, "a"), (3, "x"), (4, "m")], "id int, v string")
    target = spark.createDataFrame([(1, "o"), (1, "q"), (2, "a"), (3, "x"), (3, "y"), (4, "m"), (4, "m")], "id int, v string")
    result = reconcile(source, target, ["id"])
    assert rows(result.mismatches()) == [(1, "v", "p", "o")]
    assert rows(result.unmatched_rows()) == [(2, "source", 1, "a"), (3, "target", 1, "y"), (4, "target", 1, "m")]
    assert rows(result.states.filter("differs"), "id") == [(1,), (2,), (3,), (4,)]
    totals = result.summary().first()
    assert (totals.differing_keys, totals.value_mismatches, totals.unmatched_rows) == (4, 1, 3)


def test_differences_below_a_millionth_count(spark):
    source = spark.createDataFrame([(1, 1e-8), (2, 0.1), (3, -0.0), (4, float("nan"))], "id int, v double")
    target = spark.createDataFrame([(1, 9e-8), (2, 0.1000000001), (3, 0.0), (4, float("nan"))], "id int, v double")
    result = reconcile(source, target, ["id"])
    assert rows(result.states.filter("differs"), "id") == [(1,), (2,)]
    assert rows(result.mismatches()) == [(1, "v", "1.0E-8", "9.0E-8"), (2, "v", "0.100000", "0.1000000001")]
    assert result.summary().first().value_mismatches == 2


def test_hot_key(spark):
    """A third of all rows share a key on both sides."""
    source = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    target = source.filter("v <> 1")
    result = reconcile(source, target, ["k"])
    assert rows(result.duplicates()) == [(-1, 1000, 1000)]
    assert rows(result.missing()) == [(1,)]
    assert result.mismatches().isEmpty()


def test_removed_rows_are_missing(spark):
    source = spark.range(500).withColumn("v", F.col("id") * 2)
    target = source.filter("id % 7 <> 0")
    result = reconcile(source, target, ["id"])
    assert result.missing().count() == 72
    assert [r.id for r in result.samples("missing", 3).collect()] == [0, 7, 14]


def test_count_compare(spark):
    result = count_compare({"a": spark.range(3), "b": spark.range(2)}, {"a": spark.range(3), "c": spark.range(1)})
    assert rows(result) == [("a", 3, 3, 0, True), ("b", 2, None, -2, False), ("c", None, 1, 1, False)]


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_any_number_of_buckets_gives_the_same(spark, buckets):
    source = spark.range(4000).selectExpr("if(id % 50 = 0, null, id div 2) AS k", "id AS v", "string(id % 3) AS w")
    target = source.filter("v % 97 <> 0").selectExpr("k", "if(v % 89 = 0, v + 1, v) AS v", "w").unionAll(source.filter("v < 3"))
    result = reconcile(source, target, ["k"], buckets=buckets)
    s, t = ([tuple(r) for r in df.collect()] for df in (source, target))
    keys = {r[0] for r in s + t}
    held = {k: [sorted(r[1:] for r in side if r[0] == k) for side in (s, t)] for k in keys}
    assert rows(result.missing()) == sorted([(k,) for k, (a, b) in held.items() if not b], key=repr)
    assert rows(result.duplicates()) == sorted([(k, len(a), len(b)) for k, (a, b) in held.items() if len(a) > 1 or len(b) > 1], key=repr)
    assert rows(result.states.filter("differs"), "k") == sorted([(k,) for k, (a, b) in held.items() if a and b and a != b], key=repr)
    assert result.summary().first().source_count == 4000


def test_digests_of_parts_add_up(spark):
    whole = spark.range(900).selectExpr("id AS k", "hash(id) AS _h")
    parts = [whole.filter(f"k % 3 = {i}") for i in range(3)]
    digests = [reconciling.table_digest(p, ["k"], "_h", 64) for p in parts]
    merged = reconciling.merged_digests(digests[0].unionAll(digests[1]).unionAll(digests[2]))
    assert rows(merged) == rows(reconciling.table_digest(whole, ["k"], "_h", 64))
    compared = reconciling.compared_digests(merged, reconciling.table_digest(whole.filter("k <> 5"), ["k"], "_h", 64))
    assert compared.filter("differs").count() == reconciling.BUCKETINGS


def test_the_first_pass_shuffles_buckets_and_no_keys(spark):
    orders = spark.range(100).selectExpr("id AS k", "id AS v")
    digest = plan(reconciling.table_digest(orders.selectExpr("k", "v AS _h"), ["k"], "_h"))
    exchanges = [line for line in digest.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(bucketing" in e for e in exchanges)
    states = plan(reconciling.in_differing_buckets(orders, ["k"], reconciling.compared_digests(*[
        reconciling.table_digest(orders.selectExpr("k", "v AS _h"), ["k"], "_h")] * 2), 1 << 16))
    assert "SortMergeJoin" not in states and "hashpartitioning(k" not in states
