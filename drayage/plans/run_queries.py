"""Run records made of orders (plans), line items and events (steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.operators import runs as r
from drayage.plans.registry import Tables, query

# Texts that read the same in both engines.
STATUS = """
    CASE o_orderkey % 10 WHEN 0 THEN 'created' WHEN 1 THEN 'planning' WHEN 2 THEN 'clarifying'
        WHEN 3 THEN 'awaiting_approval' WHEN 4 THEN 'approved' WHEN 5 THEN 'rejected' WHEN 6 THEN 'executing'
        WHEN 7 THEN 'completed' WHEN 8 THEN 'failed' ELSE 'cancelled' END
"""
PLAN = f"""
    o_orderkey AS plan_id, o_custkey AS user_id, 'Migrate ' || o_orderpriority AS initial_goal,
    {STATUS} AS overall_status, 'team' || (o_custkey % 5) AS team_id, o_orderdate AS created_at
"""
STEP_STATUS = "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'skipped' END"


def plans(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS plan_id",
        "o_custkey AS user_id",
        "'Migrate ' || o_orderpriority AS initial_goal",
        f"{STATUS} AS overall_status",
        "'team' || (o_custkey % 5) AS team_id",
        "o_orderdate AS created_at",
    )


@query("plans_by_user", f"SELECT {PLAN} FROM orders")
def plans_by_user(t: Tables) -> DataFrame:
    return r.plans_by_user(plans(t))


@query(
    "messages_by_plan",
    """
    SELECT conv_id AS plan_id, turn AS timestamp, conv_id * 1000 + turn AS id, role AS agent, text AS content
    FROM conversations
    """,
)
def messages_by_plan(t: Tables) -> DataFrame:
    messages = t.conversations.selectExpr(
        "conv_id AS plan_id", "turn AS timestamp", "conv_id * 1000 + turn AS id", "role AS agent", "text AS content"
    )
    return r.messages_by_plan(messages)


@query(
    "run_status_counts",
    f"""
    WITH plans AS (SELECT {PLAN} FROM orders)
    SELECT count(*) AS total, count(*) FILTER (overall_status = 'completed') AS completed,
           count(*) FILTER (overall_status = 'failed') AS failed,
           count(*) FILTER (overall_status IN ('executing', 'planning', 'approved', 'awaiting_approval')) AS active
    FROM plans
    """,
)
def run_status_counts(t: Tables) -> DataFrame:
    return r.run_status_counts(plans(t))


@query(
    "run_search",
    f"""
    WITH plans AS (SELECT {PLAN} FROM orders)
    SELECT * FROM plans
    WHERE overall_status IN ('executing', 'planning', 'approved', 'awaiting_approval')
      AND (lower(initial_goal) LIKE '%urgent%' OR plan_id::VARCHAR LIKE '%urgent%'
           OR team_id LIKE '%urgent%' OR overall_status LIKE '%urgent%')
    UNION ALL
    SELECT * FROM plans
    WHERE overall_status NOT IN ('completed', 'failed', 'executing', 'planning', 'approved', 'awaiting_approval')
      AND (lower(initial_goal) LIKE '%99%' OR plan_id::VARCHAR LIKE '%99%'
           OR team_id LIKE '%99%' OR overall_status LIKE '%99%')
    """,
)
def run_search(t: Tables) -> DataFrame:
    return r.run_search(plans(t), "executing", "URGENT").unionAll(r.run_search(plans(t), "other", "99"))


@query(
    "run_progress",
    """
    WITH plans AS (
        SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 9 = 0 THEN [] ELSE
                   [CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'pending' END,
                    CASE WHEN o_orderkey % 2 = 0 THEN 'skipped' ELSE 'completed' END,
                    CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'in_progress' END] END AS steps
        FROM orders
    ), counted AS (
        SELECT plan_id, len(steps) AS total_steps,
               len(list_filter(steps, lambda s: s IN ('completed', 'skipped'))) AS done_steps,
               len(list_filter(steps, lambda s: s = 'completed')) AS completed_steps
        FROM plans
    )
    SELECT *, CASE WHEN total_steps > 0 THEN done_steps::DOUBLE / total_steps ELSE 0.0::DOUBLE END AS progress
    FROM counted
    """,
)
def run_progress(t: Tables) -> DataFrame:
    status = [
        "CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'pending' END",
        "if(o_orderkey % 2 = 0, 'skipped', 'completed')",
        "if(o_orderkey % 4 = 0, 'failed', 'in_progress')",
    ]
    steps = ", ".join(f"named_struct('step_number', {i}, 'status', {s})" for i, s in enumerate(status, start=1))
    plan_rows = t.orders.selectExpr(
        "o_orderkey AS plan_id", f"if(o_orderkey % 9 = 0, slice(array({steps}), 1, 0), array({steps})) AS steps"
    )
    return r.run_progress(plan_rows)


SUBTASKS = """
    SELECT l_orderkey AS plan_id, l_linenumber AS step_number, CAST(l_quantity AS BIGINT) AS prompt_tokens,
           l_suppkey AS completion_tokens, CAST(l_quantity AS BIGINT) + l_suppkey AS total_tokens,
           CAST(1 AS BIGINT) AS llm_calls
    FROM lineitem
"""


@query(
    "token_rollup",
    f"""
    WITH subtasks AS ({SUBTASKS})
    SELECT plan_id, 'step' AS level, step_number, sum(prompt_tokens)::BIGINT AS prompt_tokens,
           sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens,
           sum(llm_calls)::BIGINT AS llm_calls
    FROM subtasks GROUP BY plan_id, step_number
    UNION ALL
    SELECT plan_id, 'plan', NULL, sum(prompt_tokens)::BIGINT, sum(completion_tokens)::BIGINT, sum(total_tokens)::BIGINT,
           sum(llm_calls)::BIGINT
    FROM subtasks GROUP BY plan_id
    """,
)
def token_rollup(t: Tables) -> DataFrame:
    subtasks = t.lineitem.selectExpr(
        "l_orderkey AS plan_id",
        "l_linenumber AS step_number",
        "CAST(l_quantity AS BIGINT) AS prompt_tokens",
        "l_suppkey AS completion_tokens",
        "CAST(l_quantity AS BIGINT) + l_suppkey AS total_tokens",
        "1L AS llm_calls",
    )
    return r.token_rollup(subtasks)


@query(
    "step_durations",
    """
    SELECT event_id, CASE WHEN event_type <> 'view'
               THEN floor((floor(value * 1234567)::BIGINT + 50000) / 100000)::DOUBLE / 10 END AS duration_seconds
    FROM events
    """,
)
def step_durations(t: Tables) -> DataFrame:
    end = "timestamp_micros(unix_micros(cast(ts AS timestamp)) + cast(floor(value * 1234567D) AS bigint))"
    steps = t.events.selectExpr(
        "event_id", "ts AS started_at", f"if(event_type <> 'view', cast({end} AS timestamp_ntz), NULL) AS completed_at"
    )
    return r.step_durations(steps).select("event_id", "duration_seconds")


def line_steps(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey AS plan_id", "l_linenumber AS step_number", f"{STEP_STATUS} AS status")


@query(
    "plan_outcome",
    """
    SELECT l_orderkey AS plan_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE 'completed' END AS outcome
    FROM lineitem GROUP BY l_orderkey
    """,
)
def plan_outcome(t: Tables) -> DataFrame:
    return r.plan_outcome(line_steps(t))


@query(
    "dependency_gate",
    """
    WITH RECURSIVE steps AS (
        SELECT event_id // 20 AS plan_id, event_id % 20 + 1 AS step_number,
               CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, event_id
        FROM events
    ), wanted AS (
        SELECT plan_id, step_number, step_number - 1 AS needs FROM steps WHERE event_id % 3 = 0
        UNION SELECT plan_id, step_number, step_number - 4 FROM steps WHERE event_id % 5 = 0
        UNION SELECT plan_id, step_number, step_number + 1 FROM steps WHERE event_id % 17 = 0
    ), links AS (
        SELECT w.* FROM wanted w JOIN steps s ON s.plan_id = w.plan_id AND s.step_number = w.needs
    ), bad AS (
        SELECT plan_id, step_number FROM steps WHERE status <> 'completed'
        UNION SELECT plan_id, step_number FROM links WHERE needs >= step_number
        UNION
        SELECT l.plan_id, l.step_number FROM bad b JOIN links l ON l.plan_id = b.plan_id AND l.needs = b.step_number
        WHERE l.needs < l.step_number
    )
    SELECT plan_id, step_number, CASE WHEN EXISTS (
               SELECT 1 FROM links l WHERE l.plan_id = s.plan_id AND l.step_number = s.step_number
                 AND (l.needs >= l.step_number OR EXISTS
                      (SELECT 1 FROM bad b WHERE b.plan_id = l.plan_id AND b.step_number = l.needs)))
           THEN 'skipped' ELSE status END AS gated_status
    FROM steps s
    """,
)
def dependency_gate(t: Tables) -> DataFrame:
    steps = t.events.selectExpr(
        "event_id DIV 20 AS plan_id",
        "event_id % 20 + 1 AS step_number",
        "if(event_type = 'error', 'failed', 'completed') AS status",
        "array_compact(array(if(event_id % 3 = 0, event_id % 20, NULL), if(event_id % 5 = 0, event_id % 20 - 3, NULL), "
        "if(event_id % 17 = 0, event_id % 20 + 2, NULL))) AS dependencies",
    )
    return r.dependency_gate(steps).select("plan_id", "step_number", "gated_status")


@query(
    "run_summary",
    """
    WITH steps AS (
        SELECT conv_id AS plan_id, turn AS step_number, role AS agent,
               CASE WHEN length(text) % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, text AS output
        FROM conversations
    )
    SELECT plan_id, 0::BIGINT AS line_number, 'Migration plan completed: ' || count(*) FILTER (status = 'completed')
               || '/' || count(*) || ' steps successful.' AS line
    FROM steps GROUP BY plan_id
    UNION ALL
    SELECT plan_id, step_number, '**' || agent || '**: ' ||
           CASE WHEN length(output) > 200 THEN left(output, 200) || '...' ELSE output END FROM steps
    """,
)
def run_summary(t: Tables) -> DataFrame:
    steps = t.conversations.selectExpr(
        "conv_id AS plan_id",
        "turn AS step_number",
        "role AS agent",
        "if(length(text) % 3 = 0, 'failed', 'completed') AS status",
        "text AS output",
    )
    return r.run_summary(steps)


@query(
    "param_filter",
    f"SELECT * FROM (SELECT {PLAN} FROM orders) WHERE team_id = 'team2' AND overall_status = 'failed'",
)
def param_filter(t: Tables) -> DataFrame:
    return r.param_filter(plans(t), {"@overall_status": "failed"}, partition=("team_id", "team2"))
