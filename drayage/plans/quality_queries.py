"""Profiles and quality checks on tables with seeded faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.operators import quality as q
from drayage.operators import sketches as sk
from drayage.operators.graph import dependency_waves
from drayage.operators.reconcile import table_counts
from drayage.plans.registry import Tables, query
from drayage.sources.inventory import column_inventory

EDGES = [
    q.Edge("fk_orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    q.Edge("fk_lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    q.Edge("fk_lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
]


def faulty_orders(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey",
        "if(o_orderkey % 50 = 0, NULL, o_custkey) AS o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "nullif(o_orderpriority, '5-LOW') AS o_orderpriority",
    )


def faulty_tables(t: Tables) -> dict[str, DataFrame]:
    """Parents with a tenth missing, priorities and some keys emptied."""
    return {
        "customer": t.customer.filter("c_custkey % 10 <> 0"),
        "orders": faulty_orders(t),
        "lineitem": t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
        "part": t.part.select("p_partkey", "p_name", "p_brand"),
    }


FAULTY = """
    WITH f_customer AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0),
    f_orders AS (
        SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus,
               o_totalprice, nullif(o_orderpriority, '5-LOW') AS o_orderpriority
        FROM orders
    )
"""


@query(
    "null_profile",
    FAULTY
    + """, counts AS (
        SELECT count(*) AS row_count, count(o_orderkey) AS a, count(o_custkey) AS b, count(o_orderstatus) AS c,
               count(o_totalprice) AS d, count(o_orderpriority) AS e FROM f_orders
    ), longer AS (
        SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS column_name,
               row_count, row_count - unnest([a, b, c, d, e]) AS null_count FROM counts
    )
    SELECT column_name, row_count, null_count, 100.0::DOUBLE * null_count / row_count AS null_percent FROM longer
    """,
)
def null_profile(t: Tables) -> DataFrame:
    return q.null_profile(faulty_orders(t))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(t: Tables) -> DataFrame:
    return q.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "key_uniqueness",
    """
    SELECT 'orders' AS table_name, 'o_orderkey' AS key_columns, count(*) AS row_count,
           count(DISTINCT o_orderkey) AS distinct_count, count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders
    UNION ALL
    SELECT 'customer', 'c_custkey', count(*), count(DISTINCT c_custkey), count(*) = count(DISTINCT c_custkey)
    FROM customer
    UNION ALL
    SELECT 'customer', 'c_name, c_nationkey', count(*), count(DISTINCT (c_name, c_nationkey)),
           count(*) = count(DISTINCT (c_name, c_nationkey)) FROM customer
    UNION ALL
    SELECT 'lineitem', 'l_orderkey, l_linenumber', count(*), count(DISTINCT (l_orderkey, l_linenumber)),
           count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
    """,
)
def key_uniqueness(t: Tables) -> DataFrame:
    return q.key_uniqueness(
        {"orders": t.orders, "customer": t.customer, "lineitem": t.lineitem},
        {
            "orders": [["o_orderkey"]],
            "customer": [["c_custkey"], ["c_name", "c_nationkey"]],
            "lineitem": [["l_orderkey", "l_linenumber"]],
        },
    )


@query(
    "orphan_keys",
    FAULTY
    + """
    SELECT o_custkey AS orphan_key, count(*) AS row_count FROM f_orders o
    WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f_customer c WHERE c.c_custkey = o.o_custkey)
    GROUP BY o_custkey
    """,
)
def orphan_keys(t: Tables) -> DataFrame:
    tables = faulty_tables(t)
    return q.orphan_keys(tables["orders"], tables["customer"], "o_custkey", "c_custkey")


COVERAGE = """
    , coverage AS (
        SELECT 'fk_orders_customer' AS fk_name, 'orders' AS table_name, 'o_custkey' AS column_name,
               'customer' AS ref_table, 'c_custkey' AS ref_column, count(*) AS child_rows,
               count(*) FILTER (o_custkey IS NULL) AS null_keys,
               count(*) FILTER (o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM f_customer))
                   AS orphan_rows
        FROM f_orders
        UNION ALL
        SELECT 'fk_lineitem_orders', 'lineitem', 'l_orderkey', 'orders', 'o_orderkey', count(*), 0,
               count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM f_orders)) FROM lineitem
        UNION ALL
        SELECT 'fk_lineitem_part', 'lineitem', 'l_partkey', 'part', 'p_partkey', count(*), 0,
               count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) FROM lineitem
    )
"""


@query(
    "fk_coverage",
    FAULTY
    + COVERAGE
    + """
    SELECT *, 100.0::DOUBLE * (child_rows - null_keys - orphan_rows) / (child_rows - null_keys) AS coverage_percent
    FROM coverage
    """,
)
def fk_coverage(t: Tables) -> DataFrame:
    return q.fk_coverage(faulty_tables(t), EDGES)


@query(
    "range_format_checks",
    """
    SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS value_count,
           min(o_totalprice)::DECIMAL(38,6)::VARCHAR AS min_value, max(o_totalprice)::DECIMAL(38,6)::VARCHAR AS max_value,
           count(*) FILTER (o_totalprice < 5000) AS below_minimum,
           count(*) FILTER (o_totalprice > 450000) AS above_maximum, 0::BIGINT AS bad_format FROM orders
    UNION ALL
    SELECT 'o_orderpriority', count(p), min(p), max(p), 0, 0,
           count(*) FILTER (p IS NOT NULL AND NOT regexp_matches(p, '^[1-3]-[A-Z]+$'))
    FROM (SELECT nullif(o_orderpriority, '5-LOW') AS p FROM orders)
    UNION ALL
    SELECT 'o_custkey', count(c), min(c)::VARCHAR, max(c)::VARCHAR, count(*) FILTER (c < 10), 0, 0
    FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS c FROM orders)
    """,
)
def range_format_checks(t: Tables) -> DataFrame:
    return q.range_format_checks(
        faulty_orders(t),
        [
            q.Rule("o_totalprice", minimum=5000, maximum=450000),
            q.Rule("o_orderpriority", pattern="^[1-3]-[A-Z]+$"),
            q.Rule("o_custkey", minimum=10),
        ],
    )


@query(
    "column_profile",
    FAULTY
    + """, cells AS (
        SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS column_name,
               unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_totalprice::DECIMAL(38,6)::VARCHAR,
                       o_orderpriority]) AS value
        FROM f_orders
    ), ranked AS (
        SELECT column_name, value, count(*) AS n,
               row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rn
        FROM cells WHERE value IS NOT NULL GROUP BY column_name, value
    ), tops AS (SELECT column_name, value AS top_value, n AS top_count FROM ranked WHERE rn = 1)
    SELECT column_name, count(value) AS value_count, count(DISTINCT value) AS distinct_count, min(value) AS min_text,
           max(value) AS max_text, max(length(value))::INTEGER AS max_length,
           sum(length(value))::DOUBLE / count(value) AS avg_length, any_value(top_value) AS top_value,
           any_value(top_count) AS top_count
    FROM cells JOIN tops USING (column_name) GROUP BY column_name
    """,
)
def column_profile(t: Tables) -> DataFrame:
    return q.column_profile(faulty_orders(t), exact=True)


@query(
    "column_profile_sketched",
    FAULTY
    + """, cells AS (
        SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS column_name,
               unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_totalprice::DECIMAL(38,6)::VARCHAR,
                       o_orderpriority]) AS value
        FROM f_orders
    ), counted AS (SELECT column_name, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL),
    tops AS (SELECT column_name, max(n) AS top, count(*) AS d, sum(n)::BIGINT AS v FROM counted GROUP BY column_name)
    SELECT column_name, v AS value_count, min(value) AS min_text, max(value) AS max_text,
           max(length(value))::INTEGER AS max_length, sum(length(value) * n)::DOUBLE / v AS avg_length,
           CASE WHEN d <= 5000 THEN top END AS top_count, TRUE AS distinct_close,
           CASE WHEN column_name IN ('o_orderkey', 'o_custkey', 'o_totalprice') THEN TRUE END AS quartiles_close
    FROM counted JOIN tops USING (column_name) GROUP BY column_name, v, d, top
    """,
)
def column_profile_sketched(t: Tables) -> DataFrame:
    """Sketches of two batches, merged: exact where they add up, else held against the exact counts and ranks."""
    orders = faulty_orders(t)
    batches = [sk.column_sketches(orders.filter(f"o_orderkey % 2 = {i}")) for i in range(2)]
    merged = sk.sketched_profile(sk.merged_sketches(batches[0].unionAll(batches[1])))
    exact = q.column_profile(orders, exact=True).select("column_name", F.col("distinct_count").alias("exact"))
    numbers = ["o_orderkey", "o_custkey", "o_totalprice"]
    values = orders.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in numbers])))
    points = merged.select("column_name", F.posexplode("quantiles")).filter("pos BETWEEN 1 AND 3")
    ranks = values.filter("x IS NOT NULL").join(points, "column_name").groupBy("column_name", "pos").agg(
        F.avg((F.col("x") <= F.col("col")).cast("int")).alias("rank")
    )
    close = ranks.groupBy("column_name").agg(F.every(F.abs(F.col("rank") - F.col("pos") / 4) <= 0.02).alias("quartiles_close"))
    return merged.join(exact, "column_name").join(close, "column_name", "left").select(
        "column_name", "value_count", "min_text", "max_text", "max_length", "avg_length",
        F.when(F.col("exact") <= 5000, F.col("top_count")).alias("top_count"),
        (F.abs(F.col("distinct_count") - F.col("exact")) <= 0.08 * F.col("exact")).alias("distinct_close"), "quartiles_close",
    )


@query(
    "key_bitmaps",
    """
    SELECT 'l_orderkey' AS key_column, count(*) AS row_count, count(DISTINCT l_orderkey) AS distinct_count FROM lineitem
    UNION ALL SELECT 'l_suppkey', count(*), count(DISTINCT l_suppkey) FROM lineitem
    UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey) + max((o_custkey IS NULL)::INT)
    FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders)
    """,
)
def key_bitmaps(t: Tables) -> DataFrame:
    """Exact distinct counts from bitmaps of batches."""
    out = None
    for column, df, batch in (
        ("l_orderkey", t.lineitem, F.col("l_linenumber") < 3),
        ("l_suppkey", t.lineitem, F.col("l_returnflag") == "N"),
        ("o_custkey", faulty_orders(t), F.col("o_orderstatus") == "F"),
    ):
        parts = [sk.key_bitmaps(df.filter(b), column) for b in (batch, ~batch)]
        counts = sk.counted_bitmaps(sk.merged_bitmaps(parts[0].unionAll(parts[1])))
        part = counts.select(F.lit(column).alias("key_column"), "row_count", "distinct_count")
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "pattern_profile",
    """
    SELECT regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'),
                          '[0-9]', '9', 'g') AS pattern, count(*) AS row_count
    FROM (SELECT c_name FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_name FROM part)
    GROUP BY pattern
    """,
)
def pattern_profile(t: Tables) -> DataFrame:
    names = t.customer.select("c_name").unionAll(t.part.select("p_brand")).unionAll(t.part.select("p_name"))
    return q.pattern_profile(names, "c_name")


@query(
    "quality_scorecard",
    FAULTY
    + COVERAGE
    + """, tables AS (
        SELECT 'customer' AS table_name, count(*) AS row_count, count(*) * 5 AS cell_count, 0::BIGINT AS null_cells,
               0::BIGINT AS duplicate_rows FROM f_customer
        UNION ALL
        SELECT 'orders', count(*), count(*) * 5,
               2 * count(*) - count(o_custkey) - count(o_orderpriority), 0 FROM f_orders
        UNION ALL
        SELECT 'lineitem', count(*), count(*) * 4, 0, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
        UNION ALL SELECT 'part', count(*), count(*) * 3, 0, 0 FROM part
    ), scored AS (
        SELECT t.*, coalesce((SELECT sum(orphan_rows) FROM coverage c WHERE c.table_name = t.table_name), 0)::BIGINT
            AS orphan_rows
        FROM tables t
    )
    SELECT *, round(100.0::DOUBLE * (1.0::DOUBLE - (null_cells + duplicate_rows + orphan_rows) / cell_count), 4)
               AS quality_score, duplicate_rows > 0 OR orphan_rows > 0 AS is_blocking
    FROM scored
    """,
)
def quality_scorecard(t: Tables) -> DataFrame:
    keys = {
        "customer": ["c_custkey"],
        "orders": ["o_orderkey"],
        "lineitem": ["l_orderkey", "l_linenumber"],
        "part": ["p_partkey"],
    }
    return q.quality_scorecard(faulty_tables(t), keys, EDGES)


@query(
    "complexity_class",
    """
    WITH measures AS (
        SELECT 'customer' AS table_name, 5::BIGINT AS column_count, 2::BIGINT AS text_columns,
               (SELECT count(*) FROM customer) AS row_count, 1::BIGINT AS reference_count
        UNION ALL SELECT 'orders', 6, 2, (SELECT count(*) FROM orders), 2
        UNION ALL SELECT 'lineitem', 11, 2, (SELECT count(*) FROM lineitem), 2
        UNION ALL SELECT 'part', 6, 3, (SELECT count(*) FROM part), 1
        UNION ALL SELECT 'documents', 5, 3, (SELECT count(*) FROM documents), 0
    )
    SELECT *, CASE WHEN column_count >= 15 OR reference_count >= 4 OR text_columns >= 8 OR row_count >= 1000000000
                   THEN 'complex'
                   WHEN column_count >= 8 OR reference_count >= 2 OR text_columns >= 4 OR row_count >= 10000
                   THEN 'moderate' ELSE 'simple' END AS complexity
    FROM measures
    """,
)
def complexity_class(t: Tables) -> DataFrame:
    tables = {n: getattr(t, n) for n in ("customer", "orders", "lineitem", "part", "documents")}
    edges = t.spark.createDataFrame([(e.child, e.parent) for e in EDGES], "table_name string, ref_table string")
    return q.complexity_class(column_inventory(tables), table_counts(tables), edges)


@query(
    "dependency_waves",
    """
    WITH RECURSIVE edges AS (
        SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0
        UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 0
        UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 500 = 499
    ), closed AS (
        SELECT child, parent FROM edges WHERE parent IN (SELECT p_partkey FROM part)
    ), looped AS (
        SELECT child AS node, parent AS up, 1 AS depth FROM closed
        UNION
        SELECT l.node, c.parent, l.depth + 1 FROM looped l JOIN closed c ON l.up = c.child WHERE l.depth < 60
    ), depths AS (SELECT node, max(depth) AS depth FROM looped GROUP BY node)
    SELECT p_partkey AS node, p_size::BIGINT AS row_count,
           CASE WHEN depth >= 60 THEN NULL ELSE coalesce(depth, 0) + 1 END::INTEGER AS wave
    FROM part LEFT JOIN depths ON node = p_partkey
    """,
)
def dependency_waves_query(t: Tables) -> DataFrame:
    part = t.part
    edges = (
        part.filter("p_partkey > 0")
        .selectExpr("p_partkey AS child", "p_partkey DIV 3 AS parent")
        .unionAll(part.filter("p_partkey % 5 = 0 AND p_partkey > 0").selectExpr("p_partkey", "p_partkey - 1"))
        .unionAll(part.filter("p_partkey % 500 = 499").selectExpr("p_partkey", "p_partkey + 1"))
    )
    nodes = part.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("row_count"))
    return dependency_waves(nodes, edges)
