"""Streaming jobs over the events and orders tables, run to the end of input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.plans.load_queries import CHANGES, MERGED, order_changes
from drayage.plans.registry import Tables, query
from drayage.session import scratch_path
from drayage.streaming import jobs


def stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern also fits a single file."""
    path = t.path(name)
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def closed_windows(every: str, length: str, condition: str, columns: str) -> str:
    """Sliding windows whose end the final watermark has passed."""
    return f"""
    WITH last AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
    shifts AS (SELECT unnest(range(0, (epoch(INTERVAL {length}) / epoch(INTERVAL {every}))::BIGINT)) AS i),
    placed AS (
        SELECT events.*, time_bucket(INTERVAL {every}, ts, TIMESTAMP '1970-01-01') - i * INTERVAL {every} AS window_start
        FROM events CROSS JOIN shifts
    )
    SELECT window_start, window_start + INTERVAL {length} AS window_end, {columns}, count(*) AS runs
    FROM placed GROUP BY window_start
    HAVING {condition} AND window_start + INTERVAL {length} <= (SELECT mark FROM last)
    """


@query(
    "alert_failures",
    closed_windows(
        "5 MINUTE",
        "15 MINUTE",
        "count(*) FILTER (event_type = 'error') > 0",
        "count(*) FILTER (event_type = 'error') AS failed_runs",
    ),
)
def alert_failures(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "alert-failures")
    alerts = jobs.failure_alerts(stream(t, "events").select("ts", "event_type"), "ts", "event_type = 'error'")
    return jobs.run_append(alerts, f"{base}/out", f"{base}/checkpoint")


@query(
    "alert_duration",
    closed_windows("15 MINUTE", "1 HOUR", "max(value * 600) > 14400", "max(value * 600) AS max_seconds"),
)
def alert_duration(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "alert-duration")
    runs = stream(t, "events").selectExpr("ts", "value * 600D AS seconds")
    alerts = jobs.duration_alerts(runs, "ts", "seconds")
    return jobs.run_append(alerts, f"{base}/out", f"{base}/checkpoint")


@query("stream_dedup", "SELECT event_id FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Every message arrives once more, some of them two minutes later."""
    base = scratch_path(t.spark, "dedup")
    events = stream(t, "events").select("event_id", "ts")
    late = events.select("event_id", F.expr("ts + make_dt_interval(0, 0, if(event_id % 10 = 0, 2, 0))").alias("ts"))
    unique = jobs.deduplicate(events.unionAll(late), ["event_id"], "ts")
    return jobs.run_append(unique.select("event_id"), f"{base}/out", f"{base}/checkpoint")


@query(
    "stream_late_rows",
    """
    SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY THEN 'expired'
                          WHEN user_id % 9 > 5 THEN 'max_deliveries' ELSE 'live' END AS route
    FROM events
    """,
)
def stream_late_rows(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "late")
    messages = stream(t, "events").selectExpr("event_id", "ts", "user_id % 9 AS deliveries")
    as_of = F.lit("2024-01-31").cast("timestamp")
    routed = jobs.route_messages(messages, "ts", as_of, "deliveries").select("event_id", "route")
    return jobs.run_routed(routed, f"{base}/out", f"{base}/checkpoint").select(
        "event_id", F.col("route").cast("string").alias("route")
    )


@query("stream_incremental", "SELECT event_id, ts, event_type FROM events")
def stream_incremental(t: Tables) -> DataFrame:
    """Two runs from one checkpoint; the second sees only the new files."""
    base = scratch_path(t.spark, "stream-incremental")
    source = t.events.select("event_id", "ts", "event_type")
    for condition in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        source.filter(condition).write.mode("append").parquet(f"{base}/in")
        arriving = t.spark.readStream.schema(source.schema).parquet(f"{base}/in")
        out = jobs.run_append(arriving, f"{base}/out", f"{base}/checkpoint")
    return out


@query(
    "stream_step_state",
    """
    SELECT user_id AS plan_id, event_id % 4 AS step_number, max_by(event_type, (ts, event_id)) AS status,
           sum(floor(value * 100)::BIGINT)::BIGINT AS tokens, count(*) AS message_count
    FROM events GROUP BY user_id, event_id % 4
    """,
)
def stream_step_state(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "step-state")
    messages = stream(t, "events").selectExpr(
        "user_id AS plan_id",
        "event_id % 4 AS step_number",
        "event_id AS message_id",
        "ts",
        "event_type AS status",
        "CAST(floor(value * 100D) AS BIGINT) AS tokens",
    )
    state = jobs.step_state(messages, "ts")
    keys = ["plan_id", "step_number"]
    return jobs.run_state(state, f"{base}/out", f"{base}/checkpoint", keys)


@query("stream_merge", CHANGES + MERGED)
def stream_merge(t: Tables) -> DataFrame:
    """Two runs from one checkpoint: a key's changes come in different batches."""
    base = scratch_path(t.spark, "stream-merge")
    target = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    for part in ("seq <= 1", "seq > 1"):
        order_changes(t).filter(part).write.mode("append").parquet(f"{base}/in")
        changes = t.spark.readStream.schema(order_changes(t).schema).parquet(f"{base}/in")
        out = jobs.run_merge(changes, target, f"{base}/out", f"{base}/checkpoint", ["o_orderkey"], "seq", buckets=8)
    return out


# The events of a user and a day are the deliveries of one message; two queues with limits of their own.
DELIVERED = """
    SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS enqueued_at, count(*) AS n FROM events GROUP BY ALL
"""


def delivered(queue: str, days: int, most: int) -> str:
    return f"""
    SELECT '{queue}' AS queue, user_id, enqueued_at, CASE WHEN live THEN n END AS deliveries,
           CASE WHEN NOT live THEN 'expired' WHEN n > {most} THEN 'max_deliveries' ELSE 'live' END AS route
    FROM (SELECT *, enqueued_at >= TIMESTAMP '2024-02-01' - INTERVAL {days} DAY AS live FROM ({DELIVERED}))
    """


@query("stream_deliveries", delivered("fast", 7, 2) + " UNION ALL " + delivered("slow", 14, 4))
def stream_deliveries(t: Tables) -> DataFrame:
    messages = stream(t, "events").select("user_id", F.date_trunc("day", "ts").alias("enqueued_at"))
    out = None
    for queue, days, most in (("fast", 7, 2), ("slow", 14, 4)):
        base = scratch_path(t.spark, f"deliveries-{queue}")
        as_of = F.lit("2024-02-01").cast("timestamp")
        routed = jobs.run_deliveries(messages, f"{base}/out", f"{base}/checkpoint", "user_id", "enqueued_at", as_of, most, days)
        part = routed.select(F.lit(queue).alias("queue"), "user_id", F.col("enqueued_at").cast("timestamp_ntz").alias("enqueued_at"), "deliveries", "route")
        out = part if out is None else out.unionAll(part)
    return out
