"""Dataflow vocabulary: filter, derive, select, lookup, exists, aggregate,
union, split, surrogate key, alter-row, and a whole dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.functions.expressions import expr
from drayage.operators import dataflow as flow
from drayage.operators.keys import surrogate_key
from drayage.plans.registry import Tables, query
from drayage.sources.sinks import write_back


@query(
    "df_filter",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice
    FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 250000
    """,
)
def df_filter(t: Tables) -> DataFrame:
    rows = flow.filter_rows(t.orders, "o_orderstatus <> 'P' AND o_totalprice > 250000")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    "df_derive",
    """
    SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority, year(o_orderdate)::INTEGER AS order_year,
           md5(o_orderkey::VARCHAR) AS key_md5
    FROM orders
    """,
)
def df_derive(t: Tables) -> DataFrame:
    source = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    return flow.derive(
        source,
        {
            "o_orderpriority": expr("lower", column="o_orderpriority"),
            "order_year": expr("year", column="o_orderdate"),
            "key_md5": expr("md5", column="o_orderkey"),
        },
    ).drop("o_orderdate")


@query(
    "df_select_map",
    "SELECT c_custkey AS customer_id, c_name AS contact_name, c_acctbal AS credit_limit FROM customer",
)
def df_select_map(t: Tables) -> DataFrame:
    return flow.select_map(
        t.customer,
        [
            ("c_custkey", "customer_id"),
            ("c_name", "contact_name"),
            ("c_acctbal", "credit_limit"),
            ("c_name", "duplicate_input"),
            ("c_mktsegment", "contact_name"),
        ],
    )


@query(
    "df_rename_derive",
    """
    SELECT p_partkey AS product_id, upper(p_name) AS product_name, p_retailprice AS unit_price,
           p_brand || '/' || p_partkey::VARCHAR AS sku
    FROM part
    """,
)
def df_rename_derive(t: Tables) -> DataFrame:
    return flow.rename_derive(
        t.part.select("p_partkey", "p_name", "p_retailprice", "p_brand"),
        [("p_partkey", "product_id"), ("p_name", "product_name"), ("p_retailprice", "unit_price")],
        {
            "product_name": expr("upper", column="product_name"),
            "sku": expr("concat", column1="p_brand", separator="/", column2="product_id"),
        },
    )


@query(
    "computed_columns",
    """
    SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linestatus AS full_flag,
           l_quantity * l_extendedprice * (1.0::DOUBLE - coalesce(l_discount, 0) / 100.0::DOUBLE) AS line_total,
           l_extendedprice + coalesce(nullif(l_tax, 0.0), 0) - coalesce(l_discount, 0) AS total_amount,
           CASE WHEN nullif(l_returnflag, 'N') IS NULL THEN l_linestatus
                ELSE l_returnflag || '-' || l_linestatus END AS display_name
    FROM lineitem
    """,
)
def computed_columns(t: Tables) -> DataFrame:
    flag = "nullif(l_returnflag, 'N')"
    return flow.derive(
        t.lineitem,
        {
            "full_flag": expr("concat", column1="l_returnflag", separator=" ", column2="l_linestatus"),
            "line_total": "l_quantity * l_extendedprice * (1D - coalesce(l_discount, 0) / 100D)",
            "total_amount": "l_extendedprice + coalesce(nullif(l_tax, 0D), 0) - coalesce(l_discount, 0)",
            "display_name": f"coalesce({flag} || '-' || l_linestatus, l_linestatus)",
        },
    ).select("l_orderkey", "l_linenumber", "full_flag", "line_total", "total_amount", "display_name")


@query(
    "check_violations",
    """
    SELECT o_orderkey, 'status_list' AS rule FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL
    SELECT o_orderkey, 'price_range' AS rule FROM orders WHERE o_totalprice NOT BETWEEN 5000 AND 450000
    UNION ALL
    SELECT o_orderkey, 'priority_list' AS rule FROM orders
    WHERE nullif(o_orderpriority, '5-LOW') NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    """,
)
def check_violations(t: Tables) -> DataFrame:
    return flow.check_violations(
        t.orders,
        {
            "status_list": F.col("o_orderstatus").isin("O", "F"),
            "price_range": F.col("o_totalprice").between(5000, 450000),
            "priority_list": "nullif(o_orderpriority, '5-LOW') IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
        },
        ["o_orderkey"],
    )


@query(
    "df_lookup_first",
    """
    WITH firsts AS (
        SELECT c_nationkey, c_custkey, c_name,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
        FROM customer WHERE c_acctbal > 0
    )
    SELECT s_suppkey, s_name, c_custkey AS best_customer, c_name AS best_customer_name
    FROM supplier LEFT JOIN firsts ON s_nationkey = c_nationkey AND rn = 1
    """,
)
def df_lookup_first(t: Tables) -> DataFrame:
    return flow.lookup_first(
        t.supplier,
        t.customer.filter("c_acctbal > 0"),
        on=[("s_nationkey", "c_nationkey")],
        order_by=[F.desc("c_acctbal"), "c_custkey"],
        columns={"c_custkey": "best_customer", "c_name": "best_customer_name"},
    ).select("s_suppkey", "s_name", "best_customer", "best_customer_name")


@query(
    "df_exists",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
    """,
)
def df_exists(t: Tables) -> DataFrame:
    return flow.exists(
        t.customer.select("c_custkey", "c_name"),
        t.orders.filter("o_totalprice > 400000"),
        [("c_custkey", "o_custkey")],
    )


@query(
    "df_not_exists",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
    """,
)
def df_not_exists(t: Tables) -> DataFrame:
    return flow.exists(
        t.customer.select("c_custkey", "c_name"),
        t.orders.filter("o_totalprice > 400000"),
        [("c_custkey", "o_custkey")],
        negate=True,
    )


@query(
    "self_fk_orphans",
    """
    WITH items AS (
        SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey * 2 END AS parent_id FROM part
    )
    SELECT p_partkey, parent_id FROM items i
    WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM items p WHERE p.p_partkey = i.parent_id)
    """,
)
def self_fk_orphans(t: Tables) -> DataFrame:
    items = t.part.selectExpr("p_partkey", "if(p_partkey % 10 = 0, NULL, p_partkey * 2) AS parent_id")
    return flow.self_fk_orphans(items, "parent_id", "p_partkey")


@query(
    "df_aggregate",
    """
    SELECT l_returnflag, l_linestatus, sum(floor(l_quantity * 100 + 0.5)::BIGINT)::DOUBLE / 100 AS sum_qty,
           sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::DOUBLE / 100 AS sum_price, count(*) AS row_count
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def df_aggregate(t: Tables) -> DataFrame:
    return flow.aggregate(
        t.lineitem,
        ["l_returnflag", "l_linestatus"],
        {
            # Whole cents add up to the same sum in any order.
            "sum_qty": "CAST(sum(floor(l_quantity * 100D + 0.5D)) AS DOUBLE) / 100D",
            "sum_price": "CAST(sum(floor(l_extendedprice * 100D + 0.5D)) AS DOUBLE) / 100D",
            "row_count": "count(*)",
        },
    )


@query(
    "agg_functions",
    """
    SELECT o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS sum_value,
           CAST(sum(o_custkey) AS DOUBLE) / count(o_custkey) AS avg_value,
           min(o_totalprice) AS min_value, max(o_totalprice) AS max_value,
           count(nullif(o_orderstatus, 'P')) AS count_value, count(DISTINCT o_custkey) AS distinct_value
    FROM orders GROUP BY o_orderpriority
    """,
)
def agg_functions(t: Tables) -> DataFrame:
    return flow.aggregate(
        t.orders.withColumn("status", F.expr("nullif(o_orderstatus, 'P')")),
        ["o_orderpriority"],
        {
            "sum_value": expr("sum", column="o_custkey"),
            "avg_value": expr("avg", column="o_custkey"),
            "min_value": expr("min", column="o_totalprice"),
            "max_value": expr("max", column="o_totalprice"),
            "count_value": expr("count", column="status"),
            "distinct_value": expr("count_distinct", column="o_custkey"),
        },
    )


@query(
    "dedup_first",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                     ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS rn
        FROM lineitem) WHERE rn = 1
    """,
)
def dedup_first(t: Tables) -> DataFrame:
    source = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    order = [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice"]
    return flow.first_per_key(source, ["l_orderkey", "l_linenumber"], order).drop("l_shipdate")


@query(
    "df_union_byname",
    """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier
    """,
)
def df_union_byname(t: Tables) -> DataFrame:
    customers = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance")
    suppliers = t.supplier.selectExpr("s_acctbal AS balance", "s_name AS name", "s_suppkey AS id")
    return flow.union_by_name(customers, suppliers)


@query(
    "df_split",
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large'
                            WHEN nullif(o_orderpriority, '5-LOW') = '1-URGENT' THEN 'urgent'
                            ELSE 'rest' END AS route
    FROM orders
    """,
)
def df_split(t: Tables) -> DataFrame:
    routes = {"large": "o_totalprice > 300000", "urgent": "nullif(o_orderpriority, '5-LOW') = '1-URGENT'"}
    return flow.split(t.orders, routes, default="rest").select("o_orderkey", "route")


@query(
    "df_surrogate_key",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_sk
    FROM lineitem
    """,
)
def df_surrogate_key(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return surrogate_key(t.lineitem.select(*keys), keys, "line_sk")


@query(
    "df_alter_row",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'purchase' THEN 'upsert'
                          WHEN value > 10 THEN 'update' WHEN event_type = 'signup' THEN 'insert' END AS row_action
    FROM events
    """,
)
def df_alter_row(t: Tables) -> DataFrame:
    return flow.alter_row(
        t.events,
        insert_if="event_type = 'signup'",
        update_if="value > 10",
        upsert_if="event_type = 'purchase'",
        delete_if="event_type = 'error'",
    ).select("event_id", "row_action")


def orders_dataflow(t: Tables) -> flow.Dataflow:
    """The sample dataflow: orders with their customer, keyed and renamed."""
    return flow.Dataflow(
        source=t.orders,
        filter="o_orderstatus <> 'P'",
        lookups=[
            flow.Lookup(
                right=t.customer,
                on=[("o_custkey", "c_custkey")],
                order_by=["c_name"],
                columns={"c_name": "customer_name", "c_mktsegment": "segment"},
            )
        ],
        key=flow.SurrogateKey("order_sk", ["o_orderkey"]),
        derived={
            "order_year": expr("year", column="o_orderdate"),
            "priority": expr("upper", column="o_orderpriority"),
            "key_md5": expr("md5", column="o_orderkey"),
        },
        mapping=[
            ("o_orderkey", "order_id"),
            ("o_custkey", "customer_id"),
            ("customer_name", "customer_name"),
            ("segment", "segment"),
            ("o_totalprice", "total_amount"),
            ("o_orderdate", "order_date"),
        ],
    )


@query(
    "dataflow_orders",
    """
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
           o_totalprice AS total_amount, o_orderdate AS order_date,
           row_number() OVER (ORDER BY o_orderkey) AS order_sk, year(o_orderdate)::INTEGER AS order_year,
           upper(o_orderpriority) AS priority, md5(o_orderkey::VARCHAR) AS key_md5
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
    """,
)
def dataflow_orders(t: Tables) -> DataFrame:
    return write_back(orders_dataflow(t).run(), "dataflow-orders")
