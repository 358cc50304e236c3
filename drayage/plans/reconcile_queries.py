"""Reconciliation of orders with a target that has seeded faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.operators.reconcile import Reconciliation, count_compare, key_difference, reconcile
from drayage.plans.registry import Tables, query


def source_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def target_orders(t: Tables) -> DataFrame:
    """Changed prices, also by less than a millionth, emptied states, missing, extra and repeated keys."""
    kept = source_orders(t).filter("o_orderkey % 101 <> 0").selectExpr(
        "o_orderkey",
        "o_custkey",
        "if(o_orderkey % 89 = 0, nullif(o_orderstatus, 'P'), o_orderstatus) AS o_orderstatus",
        "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 83 = 0 THEN o_totalprice + 0.0000005D "
        "ELSE o_totalprice END AS o_totalprice",
        "o_orderdate",
    )
    extra = source_orders(t).filter("o_orderkey % 103 = 0").withColumn("o_orderkey", F.expr("o_orderkey + 10000000"))
    same_again = source_orders(t).filter("o_orderkey % 107 = 0 AND o_orderkey % 101 <> 0")
    other_again = source_orders(t).filter("o_orderkey % 109 = 0").withColumn("o_orderstatus", F.lit("X"))
    return kept.unionAll(extra).unionAll(same_again).unionAll(other_again)


# Cells as text: six decimals where they hold a price exactly.
CELLS = """o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
           CASE WHEN o_totalprice::DECIMAL(38,6)::DOUBLE = o_totalprice THEN o_totalprice::DECIMAL(38,6)::VARCHAR
                ELSE o_totalprice::VARCHAR END AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate"""

SIDES = f"""
    WITH source AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders),
    target AS (
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 89 = 0 THEN nullif(o_orderstatus, 'P') ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 83 = 0
                    THEN o_totalprice + 0.0000005::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderdate
        FROM source WHERE o_orderkey % 101 <> 0
        UNION ALL
        SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate
        FROM source WHERE o_orderkey % 103 = 0
        UNION ALL SELECT * FROM source WHERE o_orderkey % 107 = 0 AND o_orderkey % 101 <> 0
        UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice, o_orderdate FROM source WHERE o_orderkey % 109 = 0
    ),
    s_text AS (SELECT {CELLS} FROM source WHERE o_orderkey IN (SELECT o_orderkey FROM target)),
    t_text AS (SELECT {CELLS} FROM target WHERE o_orderkey IN (SELECT o_orderkey FROM source)),
    s_more AS (SELECT * FROM s_text EXCEPT ALL SELECT * FROM t_text),
    t_more AS (SELECT * FROM t_text EXCEPT ALL SELECT * FROM s_text),
    differing AS (SELECT o_orderkey FROM s_more UNION SELECT o_orderkey FROM t_more),
    paired AS (
        SELECT o_orderkey FROM differing d
        WHERE (SELECT count(*) FROM s_more s WHERE s.o_orderkey = d.o_orderkey) = 1
          AND (SELECT count(*) FROM t_more t WHERE t.o_orderkey = d.o_orderkey) = 1
    ),
    cells AS (
        SELECT s.o_orderkey, unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate']) AS column_name,
               unnest([s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate]) AS source,
               unnest([t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate]) AS target
        FROM paired JOIN s_more s USING (o_orderkey) JOIN t_more t USING (o_orderkey)
    ),
    mismatches AS (SELECT * FROM cells WHERE source IS DISTINCT FROM target),
    unmatched AS (
        SELECT 'source' AS side, * FROM s_more WHERE o_orderkey NOT IN (SELECT o_orderkey FROM paired)
        UNION ALL SELECT 'target', * FROM t_more WHERE o_orderkey NOT IN (SELECT o_orderkey FROM paired)
    )
"""


def orders_reconciliation(t: Tables) -> Reconciliation:
    return reconcile(source_orders(t), target_orders(t), ["o_orderkey"])


@query(
    "reconcile_summary",
    SIDES
    + """
    SELECT (SELECT count(*) FROM source) AS source_count, (SELECT count(*) FROM target) AS target_count,
           (SELECT count(*) FROM source s WHERE NOT EXISTS
               (SELECT 1 FROM target t WHERE t.o_orderkey = s.o_orderkey)) AS missing_in_target,
           (SELECT count(*) FROM target t WHERE NOT EXISTS
               (SELECT 1 FROM source s WHERE t.o_orderkey = s.o_orderkey)) AS extra_in_target,
           0::BIGINT AS duplicate_source_keys,
           (SELECT count(*) FROM (SELECT o_orderkey FROM target GROUP BY 1 HAVING count(*) > 1)) AS duplicate_target_keys,
           (SELECT count(*) FROM differing) AS differing_keys,
           (SELECT count(*) FROM mismatches) AS value_mismatches, (SELECT count(*) FROM unmatched) AS unmatched_rows
    """,
)
def reconcile_summary(t: Tables) -> DataFrame:
    return orders_reconciliation(t).summary()


@query("reconcile_mismatches", SIDES + "SELECT o_orderkey, column_name, source, target FROM mismatches")
def reconcile_mismatches(t: Tables) -> DataFrame:
    return orders_reconciliation(t).mismatches()


@query(
    "reconcile_unmatched",
    SIDES + "SELECT o_orderkey, side, count(*) AS row_count, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM unmatched GROUP BY ALL",
)
def reconcile_unmatched(t: Tables) -> DataFrame:
    return orders_reconciliation(t).unmatched_rows()


@query(
    "reconcile_samples",
    SIDES + "SELECT o_orderkey, column_name, source, target FROM mismatches ORDER BY o_orderkey, column_name LIMIT 50",
)
def reconcile_samples(t: Tables) -> DataFrame:
    return orders_reconciliation(t).samples("mismatches", 50)


@query(
    "reconcile_missing",
    SIDES + "SELECT o_orderkey FROM source EXCEPT SELECT o_orderkey FROM target",
)
def reconcile_missing(t: Tables) -> DataFrame:
    return key_difference(source_orders(t), target_orders(t), ["o_orderkey"])


@query(
    "reconcile_extra",
    SIDES + "SELECT o_orderkey FROM target EXCEPT SELECT o_orderkey FROM source",
)
def reconcile_extra(t: Tables) -> DataFrame:
    return key_difference(target_orders(t), source_orders(t), ["o_orderkey"])


@query(
    "reconcile_duplicates",
    """
    WITH target AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')
    SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber,
           coalesce(s.n, 0) AS n_source, coalesce(t.n, 0) AS n_target
    FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) s
    FULL JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM target GROUP BY ALL) t
      ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber
    WHERE s.n > 1 OR t.n > 1
    """,
)
def reconcile_duplicates(t: Tables) -> DataFrame:
    source = t.lineitem
    target = t.lineitem.filter("l_shipdate < TIMESTAMP_NTZ '2000-01-01'")
    return reconcile(source, target, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_extendedprice"]).duplicates()


@query(
    "count_compare",
    """
    WITH s AS (
        SELECT 'customer' AS table_name, count(*) AS source_count FROM customer
        UNION ALL SELECT 'orders', count(*) FROM orders
        UNION ALL SELECT 'part', count(*) FROM part
    ), t AS (
        SELECT 'customer' AS table_name, count(*) AS target_count FROM customer
        UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 101 <> 0
        UNION ALL SELECT 'lineitem', count(*) FROM lineitem
    )
    SELECT table_name, source_count, target_count,
           coalesce(target_count, 0) - coalesce(source_count, 0) AS difference,
           source_count IS NOT DISTINCT FROM target_count AS matches
    FROM s FULL JOIN t USING (table_name)
    """,
)
def count_compare_query(t: Tables) -> DataFrame:
    return count_compare(
        {"customer": t.customer, "orders": t.orders, "part": t.part},
        {"customer": t.customer, "orders": t.orders.filter("o_orderkey % 101 <> 0"), "lineitem": t.lineitem},
    )
