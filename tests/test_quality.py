from __future__ import annotations

import random

import shop
from frames import plan, rows
from pyspark.sql import functions as F

from drayage.operators import quality as q
from drayage.operators import sketches as sk
from drayage.operators.graph import dependency_waves
from drayage.sources.inventory import column_inventory, schema_table_counts


def test_null_profile(spark):
    got = rows(q.null_profile(shop.employees(spark), ["phone", "manager_id"]))
    assert got == [("manager_id", 6, 3, 50.0), ("phone", 6, 1, 100 / 6)]
    assert rows(q.null_profile(spark.range(0))) == [("id", 0, 0, 0.0)]


def test_orphans_ignore_null(spark):
    orders = shop.orders(spark)
    staff = shop.employees(spark).filter("employee_id <> 103")
    assert rows(q.orphan_keys(orders, staff, "employee_id", "employee_id")) == [(103, 2)]
    edge = q.Edge("fk", "orders", "employee_id", "employees", "employee_id")
    got = q.fk_coverage({"orders": orders, "employees": staff}, [edge]).first()
    assert (got.child_rows, got.null_keys, got.orphan_rows, got.coverage_percent) == (6, 1, 2, 60.0)


def test_duplicate_parents_do_not_multiply(spark):
    child = spark.createDataFrame([(1,), (1,), (2,)], "fk int")
    parent = spark.createDataFrame([(1,), (1,)], "pk int")
    got = q.fk_coverage({"c": child, "p": parent}, [q.Edge("e", "c", "fk", "p", "pk")]).first()
    assert (got.child_rows, got.orphan_rows) == (3, 1)


def test_key_uniqueness_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    got = q.key_uniqueness({"t": df}, {"t": [["a", "b"], ["a"]]})
    assert rows(got, "key_columns", "row_count", "distinct_count", "is_unique") == [("a", 3, 2, False), ("a, b", 3, 2, False)]


def test_range_and_format(spark):
    df = spark.createDataFrame([(1, "+1-555-0101"), (9, "bad"), (None, None)], "rating int, phone string")
    got = q.range_format_checks(df, [q.Rule("rating", 1, 5), q.Rule("phone", pattern=r"^\+1-\d{3}-\d{4}$")])
    assert rows(got) == [("phone", 2, "+1-555-0101", "bad", 0, 0, 1), ("rating", 2, "1", "9", 0, 1, 0)]


def test_profiles_agree(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("a"), F.expr("if(id % 3 = 0, NULL, concat('v', id % 5))").alias("b"))
    exact = {r.column_name: r for r in q.column_profile(df, exact=True).collect()}
    sketch = {r.column_name: r for r in q.column_profile(df).collect()}
    for name in ("a", "b"):
        for field in ("value_count", "distinct_count", "min_text", "max_text", "max_length", "avg_length"):
            assert exact[name][field] == sketch[name][field], (name, field)
        assert exact[name].top_count == sketch[name].top_count
    assert (exact["a"].top_value, exact["a"].top_count) == ("0", 29) == (sketch["a"].top_value, sketch["a"].top_count)
    assert sketch["a"].quantiles == [0, 1, 3, 5, 6] and sketch["b"].quantiles is None


def test_patterns(spark):
    got = rows(q.pattern_profile(shop.employees(spark).filter("phone IS NOT NULL"), "phone"))
    assert got == [("+9-999-9999", 5)]


def test_scorecard(spark):
    tables = {"orders": shop.orders(spark), "employees": shop.employees(spark).filter("employee_id <> 103")}
    edge = q.Edge("fk", "orders", "employee_id", "employees", "employee_id")
    got = {r.table_name: r for r in q.quality_scorecard(tables, {"orders": ["order_id"]}, [edge]).collect()}
    assert got["orders"].is_blocking and got["orders"].orphan_rows == 2
    assert got["orders"].quality_score == round(100 * (1 - 3 / 48), 4)
    assert not got["employees"].is_blocking


def test_complexity(spark):
    inventory = column_inventory({"a": spark.range(1), "b": spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(20)])})
    counts = spark.createDataFrame([("a", 1), ("b", 1)], "table_name string, row_count bigint")
    edges = spark.createDataFrame([], "table_name string, ref_table string")
    assert rows(q.complexity_class(inventory, counts, edges), "table_name", "complexity") == [("a", "simple"), ("b", "complex")]


def waves_of(spark, names, pairs):
    nodes = spark.createDataFrame([(n, 1) for n in names], "node string, row_count bigint")
    edges = spark.createDataFrame(pairs, "child string, parent string")
    return {r.node: r.wave for r in dependency_waves(nodes, edges).collect()}


def test_waves_of_the_shop(spark):
    edges = [
        ("employees", "departments"),
        ("employees", "employees"),
        ("products", "categories"),
        ("orders", "customers"),
        ("orders", "employees"),
        ("order_items", "orders"),
        ("order_items", "products"),
        ("orders", "unknown"),
    ]
    names = ["departments", "employees", "categories", "products", "customers", "orders", "order_items"]
    assert waves_of(spark, names, edges) == {
        "departments": 1,
        "categories": 1,
        "customers": 1,
        "employees": 2,
        "products": 2,
        "orders": 3,
        "order_items": 4,
    }


def plain_waves(names, pairs):
    ups = {n: {p for c, p in pairs if c == n and p != n and p in names} for n in names}
    wave = {}
    while ready := [n for n in names if n not in wave and all(p in wave for p in ups[n])]:
        wave |= {n: 1 + max([wave[p] for p in ups[n]], default=0) for n in ready}
    return {n: wave.get(n) for n in names}


def test_waves_of_random_graphs(spark):
    r = random.Random(12)
    for size, edges in ((12, 8), (30, 26), (30, 33), (60, 55)):
        names = [f"n{i}" for i in range(size)]
        order = r.sample(names, size)
        pairs = []
        for _ in range(edges):
            i, j = sorted(r.sample(range(size), 2))
            pairs.append((order[j], order[i]) if r.random() < 0.96 else (order[i], order[j]))
        pairs += [("n0", "n0"), ("n1", "nowhere"), pairs[0]]
        assert waves_of(spark, names, pairs) == plain_waves(names, pairs)


def test_waves_of_long_chains(spark):
    """Two chains of 300, one closed into a ring, one that leads from a cycle: rounds grow with the logarithm."""
    names = [f"{c}{i}" for c in "abrq" for i in range(300)] + ["x", "y", "z"]
    pairs = [(f"{c}{i + 1}", f"{c}{i}") for c in "abrq" for i in range(299)]
    pairs += [("r0", "r299"), ("q0", "x"), ("x", "y"), ("y", "x"), ("z", "a299"), ("z", "b7")]
    nodes = spark.createDataFrame([(n, 1) for n in names], "node string, row_count bigint")
    seen = []
    from drayage.operators import graph

    materialise = graph.materialise
    graph.materialise = lambda df, label: seen.append(label) or materialise(df, label)
    try:
        got = {r.node: r.wave for r in dependency_waves(nodes, spark.createDataFrame(pairs, "child string, parent string")).collect()}
    finally:
        graph.materialise = materialise
    assert got == plain_waves(names, pairs)
    assert seen.count("chains") <= 12 and seen.count("depths") <= 8


def test_waves_report_cycles_and_what_lies_behind(spark):
    got = waves_of(spark, "abcde", [("a", "b"), ("b", "a"), ("c", "a"), ("d", "e")])
    assert got == {"a": None, "b": None, "c": None, "d": 2, "e": 1}


def test_waves_without_edges(spark):
    assert waves_of(spark, "ab", []) == {"a": 1, "b": 1}


def test_waves_match_brute_force(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    pairs = [(names[i], names[rng.randrange(i)]) for i in range(1, 40) for _ in range(2)]
    depth: dict[str, int] = {}
    for i, n in enumerate(names):
        depth[n] = 1 + max((depth[p] for c, p in pairs if c == n), default=0)
    assert waves_of(spark, names, pairs) == depth


def test_schemas_without_tables_count_zero(spark):
    schemas = spark.createDataFrame([("app",), ("empty",), ("INFORMATION_SCHEMA",)], "schema_name string")
    tables = spark.createDataFrame([("app", "a"), ("app", "b"), ("other", "c")], "schema_name string, table_name string")
    assert rows(schema_table_counts(schemas, tables)) == [("app", 2), ("empty", 0)]


def test_sketches_of_parts_merge(spark):
    df = spark.range(5000).selectExpr("id * 3 AS a", "if(id % 3 = 0, NULL, id % 50) AS b", "double(null) AS c", "string(id) AS d")
    parts = [sk.column_sketches(df.filter(f"a % 4 = {i}")) for i in range(4)] + [sk.column_sketches(df.limit(0))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    merged = {r.column_name: r for r in sk.sketched_profile(sk.merged_sketches(both)).collect()}
    whole = {r.column_name: r for r in sk.sketched_profile(sk.column_sketches(df)).collect()}
    for name in df.columns:
        for field in ("value_count", "min_text", "max_text", "max_length", "avg_length"):
            assert merged[name][field] == whole[name][field]
        assert abs(merged[name].distinct_count - df.select(name).distinct().dropna().count()) <= 0.08 * 5000
    assert [[v["count"] for v in x["b"].top_values] for x in (merged, whole)] == [[67] * 10] * 2  # of a tie any ten
    assert merged["c"].value_count == 0 and merged["c"].quantiles is None and merged["c"].top_value is None
    assert abs(merged["a"].quantiles[2] - 7500) <= 0.02 * 15000


def test_bitmaps_count_exactly(spark):
    r = random.Random(8)
    keys = [r.choice([r.randint(-70_000, 70_000), r.randint(-(2**62), 2**62), 0, 32768, -32768, None]) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    want = (len(keys), len(set(keys)))
    assert rows(sk.counted_bitmaps(sk.key_bitmaps(df, "k"))) == [want]
    parts = sk.key_bitmaps(df.filter("k > 0 OR k IS NULL"), "k").unionAll(sk.key_bitmaps(df.filter("k <= 5"), "k"))
    assert rows(sk.counted_bitmaps(sk.merged_bitmaps(parts)), "distinct_count") == [(len(set(keys)),)]
    assert rows(sk.counted_bitmaps(sk.key_bitmaps(df.limit(0), "k"))) == [(0, 0)]


def test_keys_that_lie_apart_are_not_made_bitmaps(spark):
    close, apart = spark.range(100_000).selectExpr("id AS k"), spark.range(100_000).selectExpr("id * 1000003 AS k")
    assert sk.bitmaps_pay(close, "k") and not sk.bitmaps_pay(apart, "k")
    for df in (close, apart):
        assert rows(sk.distinct_keys(df.unionAll(df.limit(5)), ["k"])) == [(100_005, 100_000)]
    text = plan(sk.key_bitmaps(close, "k"))
    assert "hashpartitioning(k" not in text
