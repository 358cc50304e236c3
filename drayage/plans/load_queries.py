"""Loads over events and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.operators import load
from drayage.plans.registry import ALL_TABLES, Tables, query
from drayage.session import scratch_path


@query(
    "incremental_load",
    """
    SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type,
           CASE WHEN ts < TIMESTAMP '2024-01-09' OR (ts < TIMESTAMP '2024-01-10' AND event_id % 2 = 0) THEN 1
                WHEN ts < TIMESTAMP '2024-01-19' OR (ts < TIMESTAMP '2024-01-20' AND event_id % 2 = 0) THEN 2
                ELSE 3 END::BIGINT AS batch_id
    FROM events
    """,
)
def incremental_load(t: Tables) -> DataFrame:
    """By day: half of a run's last day comes only after the run, at its watermark."""
    base = scratch_path(t.spark, "incremental")
    source = t.events.select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type")
    for last in ("2024-01-09", "2024-01-19", "2100-01-01", "2100-01-01"):  # the last run finds nothing new
        day = F.lit(last).cast("timestamp_ntz")
        seen = source.filter((F.col("day") < day) | ((F.col("day") == day) & (F.col("event_id") % 2 == 0)))
        load.incremental_load(seen, f"{base}/target", f"{base}/state", "events", "day")
    loaded = t.spark.read.parquet(f"{base}/target")
    return loaded.withColumn("batch_id", F.col("batch_id").cast("long"))


@query(
    "incremental_load_tables",
    """
    SELECT 'events' AS table_name, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END::BIGINT AS batch_id,
           count(*) AS row_count FROM events GROUP BY 2
    UNION ALL
    SELECT 'orders', CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END::BIGINT, count(*)
    FROM orders GROUP BY 2
    """,
)
def incremental_load_tables(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "incremental")
    for events_until, orders_until in (("2024-01-15", "1998-01-01"), ("2100-01-01", "2100-01-01")):
        sources = {
            "events": (t.events.filter(F.col("ts") < F.lit(events_until).cast("timestamp_ntz")), "ts"),
            "orders": (t.orders.filter(F.col("o_orderdate") < F.lit(orders_until).cast("timestamp_ntz")), "o_orderdate"),
        }
        load.incremental_load_tables(sources, f"{base}/target", f"{base}/state")
    parts = [
        t.spark.read.parquet(f"{base}/target/{name}")
        .groupBy(F.lit(name).alias("table_name"), F.col("batch_id").cast("long").alias("batch_id"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        for name in ("events", "orders")
    ]
    return parts[0].unionAll(parts[1])


@query(
    "scd2_history",
    """
    WITH ordered AS (
        SELECT user_id, event_type, ts, event_id,
               lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events
    ), opened AS (SELECT * FROM ordered WHERE before IS NULL OR before <> event_type)
    SELECT user_id, event_type, ts AS valid_from,
           lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to,
           lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS is_current
    FROM opened
    """,
)
def scd2_history(t: Tables) -> DataFrame:
    return load.scd2_history(t.events, ["user_id"], ["event_type"], "ts", "event_id")


def order_changes(t: Tables) -> DataFrame:
    """Changes of all kinds, also several of one key that undo each other."""
    source = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")

    def part(where: str, shift: int, rise: int, sequence: int, action: str) -> DataFrame:
        return source.filter(where).select(
            (F.col("o_orderkey") + shift).alias("o_orderkey"),
            "o_custkey",
            (F.col("o_totalprice") + rise).alias("o_totalprice"),
            F.lit(sequence).alias("seq"),
            F.lit(action).alias("row_action"),
        )

    return reduce(DataFrame.unionAll, [part(*x) for x in ORDER_CHANGES])


# Which orders, what is added to key and price, sequence and action.
ORDER_CHANGES = [
    ("o_orderkey % 3 = 0", 0, 1, 1, "update"),
    ("o_orderkey % 6 = 0", 0, 0, 2, "delete"),
    ("o_orderkey % 11 = 1", 0, 1, 3, "insert"),
    ("o_orderkey % 12 = 0", 0, 5, 4, "update"),
    ("o_orderkey % 7 = 0", 10_000_000, 0, 1, "upsert"),
    ("o_orderkey % 35 = 0", 10_000_000, 1, 2, "upsert"),
    ("o_orderkey % 21 = 0", 10_000_000, 0, 3, "delete"),
    ("o_orderkey % 13 = 0", 20_000_000, 0, 1, "update"),
    ("o_orderkey % 5 = 0", 30_000_000, 0, 1, "insert"),
    ("o_orderkey % 10 = 0", 30_000_000, 2, 2, "update"),
    ("o_orderkey % 20 = 0", 30_000_000, 9, 3, "insert"),
]

# The changes folded one by one: present and price after each.
CHANGES = (
    """
    WITH RECURSIVE target AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders),
    changes AS ("""
    + " UNION ALL ".join(
        f"SELECT o_orderkey + {shift} AS o_orderkey, o_custkey, o_totalprice + {rise} AS o_totalprice, {seq} AS seq, "
        f"'{action}' AS row_action FROM orders WHERE {where}"
        for where, shift, rise, seq, action in ORDER_CHANGES
    )
    + """),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq) AS rn FROM changes),
    fold AS (
        SELECT k.o_orderkey, 0::BIGINT AS rn, t.o_orderkey IS NOT NULL AS present, t.o_custkey, t.o_totalprice,
               0 AS seq, NULL::VARCHAR AS row_action, FALSE AS idle
        FROM (SELECT DISTINCT o_orderkey FROM changes) k LEFT JOIN target t USING (o_orderkey)
        UNION ALL
        SELECT f.o_orderkey, n.rn,
               CASE n.row_action WHEN 'delete' THEN FALSE WHEN 'update' THEN f.present ELSE TRUE END,
               CASE WHEN n.row_action = 'upsert' OR (n.row_action = 'update') = f.present AND n.row_action <> 'delete'
                    THEN n.o_custkey ELSE f.o_custkey END,
               CASE WHEN n.row_action = 'upsert' OR (n.row_action = 'update') = f.present AND n.row_action <> 'delete'
                    THEN n.o_totalprice ELSE f.o_totalprice END,
               n.seq, n.row_action,
               CASE n.row_action WHEN 'insert' THEN f.present WHEN 'upsert' THEN FALSE ELSE NOT f.present END
        FROM fold f JOIN numbered n ON n.o_orderkey = f.o_orderkey AND n.rn = f.rn + 1
    ),
    ended AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY rn DESC) = 1)
"""
)

MERGED = """
    SELECT t.* FROM target t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ended)
    UNION ALL
    SELECT o_orderkey, o_custkey, o_totalprice FROM ended WHERE present
"""


@query("merge_upsert", CHANGES + MERGED)
def merge_upsert(t: Tables) -> DataFrame:
    target = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return load.merge_upsert(target, order_changes(t), ["o_orderkey"], "seq")


@query("merge_conflicts", CHANGES + "SELECT o_orderkey, seq, row_action FROM fold WHERE idle")
def merge_conflicts(t: Tables) -> DataFrame:
    target = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return load.merge_conflicts(target, order_changes(t), ["o_orderkey"], "seq")


def change_log(t: Tables) -> DataFrame:
    """Events read as a change log: sign-ups insert, errors delete, the rest
    update the field named after the event."""
    return t.events.select(
        F.col("user_id").alias("record_id"),
        F.col("event_id").alias("log_id"),
        F.expr(
            "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"
        ).alias("event_type"),
        F.expr(
            "to_json(map(concat(event_type, '_', event_id % 5), cast(event_id AS string), 'props', props))"
        ).alias("new_values"),
    )


@query(
    "changelog_replay",
    """
    WITH RECURSIVE log AS (
        SELECT user_id AS record_id, event_id, event_type, props,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events
    ), fold AS (
        SELECT DISTINCT record_id, 0::BIGINT AS rn, TRUE AS alive, MAP {}::MAP(VARCHAR, VARCHAR) AS fields FROM log
        UNION ALL
        SELECT f.record_id, l.rn,
               CASE l.event_type WHEN 'signup' THEN TRUE WHEN 'error' THEN FALSE ELSE f.alive END,
               CASE WHEN l.event_type = 'error' THEN MAP {}::MAP(VARCHAR, VARCHAR)
                    WHEN l.event_type = 'signup'
                    THEN MAP {'signup_' || l.event_id % 5: l.event_id::VARCHAR, 'props': l.props}
                    WHEN f.alive
                    THEN map_concat(f.fields, MAP {l.event_type || '_' || l.event_id % 5: l.event_id::VARCHAR, 'props': l.props})
                    ELSE f.fields END
        FROM fold f JOIN log l ON l.record_id = f.record_id AND l.rn = f.rn + 1
    ), ended AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY rn DESC) = 1)
    SELECT record_id, alive, e.key AS field, e.value AS value
    FROM ended, unnest(CASE WHEN alive AND cardinality(fields) > 0 THEN map_entries(fields) ELSE [NULL] END) AS u(e)
    """,
)
def changelog_replay(t: Tables) -> DataFrame:
    return load.changelog_replay(change_log(t), ["record_id"], "log_id")


@query(
    "copy_tables",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, 'copied' AS status, count(*) AS row_count, NULL::VARCHAR AS message FROM {n}"
        for n in ALL_TABLES
    ),
)
def copy_tables(t: Tables) -> DataFrame:
    return load.copy_tables({n: getattr(t, n) for n in ALL_TABLES}, scratch_path(t.spark, "copy"))
