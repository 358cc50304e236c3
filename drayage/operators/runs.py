"""Run records: plans, steps, messages, progress, tokens and gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.session import materialise

# Statuses of plans and steps.
COMPLETED, FAILED, SKIPPED = "completed", "failed", "skipped"
ACTIVE_STATUSES = ("executing", "planning", "approved", "awaiting_approval")
SEARCHED = ("initial_goal", "plan_id", "team_id", "overall_status")
# Short parameter names and the fields they stand for.
PARAMETER_FIELDS = {"uid": "user_id", "pid": "plan_id", "tid": "id"}

HEAD_LENGTH = 200


def plans_by_user(plans: DataFrame, user: object = None) -> DataFrame:
    """A user's plans, newest first; without a user all plans, user by user.

    On a table partitioned by user the filter prunes to one partition.
    """
    wanted = plans if user is None else plans.filter(F.col("user_id") == F.lit(user))
    return wanted.orderBy("user_id", F.desc("created_at"), "plan_id")


def messages_by_plan(messages: DataFrame, plan: object = None) -> DataFrame:
    """A plan's messages, oldest first; without a plan all, plan by plan."""
    wanted = messages if plan is None else messages.filter(F.col("plan_id") == F.lit(plan))
    return wanted.orderBy("plan_id", "timestamp", "id")


def run_status_counts(plans: DataFrame) -> DataFrame:
    """One row: all plans, completed, failed and active ones."""
    status = F.col("overall_status")
    return plans.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == COMPLETED).alias("completed"),
        F.count_if(status == FAILED).alias("failed"),
        F.count_if(status.isin(*ACTIVE_STATUSES)).alias("active"),
    )


def _in_group(group: str) -> Column:
    status = F.col("overall_status")
    groups = {
        "all": F.lit(True),
        "completed": status == COMPLETED,
        "failed": status == FAILED,
        "executing": status.isin(*ACTIVE_STATUSES),
        "other": ~status.isin(COMPLETED, FAILED, *ACTIVE_STATUSES),
    }
    return groups[group]


def run_search(plans: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    """Plans of a status group whose goal, id, team or status holds ``text``."""
    found = plans.filter(_in_group(status))
    if text.strip():
        hit = F.lit(False)
        for name in SEARCHED:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(name).cast("string")), F.lit(text.lower())), F.lit(False))
        found = found.filter(hit)
    return found


def run_progress(plans: DataFrame, steps: str = "steps") -> DataFrame:
    """Per plan with an array of steps: how many are done, and the share.

    Skipped steps count as done for the share but not in ``completed_steps``.
    """
    done = F.filter(steps, lambda s: s["status"].isin(COMPLETED, SKIPPED))
    total = F.greatest(F.size(steps), F.lit(0))
    return plans.select(
        "plan_id",
        total.cast("long").alias("total_steps"),
        F.greatest(F.size(done), F.lit(0)).cast("long").alias("done_steps"),
        F.greatest(F.size(F.filter(steps, lambda s: s["status"] == COMPLETED)), F.lit(0))
        .cast("long")
        .alias("completed_steps"),
        F.when(total > 0, F.size(done) / total).otherwise(F.lit(0.0)).alias("progress"),
    )


def token_rollup(subtasks: DataFrame) -> DataFrame:
    """Token sums of sub-tasks per step (``level`` step) and per plan (plan).

    Plans are summed from the step sums, not from the sub-tasks again.
    """
    names = ["prompt_tokens", "completion_tokens", "total_tokens", "llm_calls"]
    steps = subtasks.groupBy("plan_id", "step_number").agg(*[F.sum(n).alias(n) for n in names])
    per_level = steps.groupingSets(
        [["plan_id", "step_number"], ["plan_id"]], "plan_id", "step_number"
    ).agg(F.grouping("step_number").alias("_plan"), *[F.sum(n).alias(n) for n in names])
    level = F.when(F.col("_plan") == 1, "plan").otherwise("step")
    return per_level.select("plan_id", level.alias("level"), "step_number", *names)


def step_durations(steps: DataFrame) -> DataFrame:
    """``duration_seconds`` to a tenth, half up; NULL while a step runs."""
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    tenths = F.floor((micros + 50_000) / 100_000)
    return steps.withColumn("duration_seconds", tenths.cast("double") / 10)


def plan_outcome(steps: DataFrame) -> DataFrame:
    """FAILED if a step failed, else COMPLETED; skipped steps do not count."""
    failed = F.bool_or(F.col("status") == FAILED)
    return steps.groupBy("plan_id").agg(F.when(failed, FAILED).otherwise(COMPLETED).alias("outcome"))


# Steps of a plan that are folded in one row; longer plans are worked off link by link.
FOLDED_STEPS = 4096

# Rounds after which what was reached is written as one table.
FOLD_ROUNDS = 8


def dependency_gate(steps: DataFrame, folded: int = FOLDED_STEPS) -> DataFrame:
    """Final ``gated_status`` of each step: skipped if a dependency is not met.

    ``steps`` holds ``plan_id, step_number, status, dependencies``, run in step
    order; ``status`` is the outcome of a step that runs. A dependency is met
    if it came earlier and is completed; one on an unknown step is ignored.
    Rows of one step number are one step, with the dependencies of all.

    A plan's steps are one sorted array, folded once: the state is a flag per
    step so far. So the number of jobs does not hang on how deep links go. Only numbers,
    flags and dependencies are gathered. Plans of more than ``folded`` steps
    are not gathered at all: there failures spread link by link.
    """
    own = F.coalesce(F.col("status") != COMPLETED, F.lit(False))
    numbered = steps.groupBy("plan_id", "step_number").agg(
        F.bool_or(own).alias("bad"), F.array_distinct(F.flatten(F.collect_list("dependencies"))).alias("needs")
    )
    numbered = materialise(numbered, "gate-steps")
    long = numbered.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > folded).select("plan_id")
    long = materialise(long, "gate-long")
    if long.isEmpty():
        skipped = _folded_skips(numbered)
    else:
        by_plan = numbered["plan_id"].eqNullSafe(long["plan_id"])
        skipped = _folded_skips(numbered.join(long, by_plan, "left_anti"))
        skipped = skipped.unionAll(_spread_skips(numbered.join(long, by_plan, "left_semi")))
    named = skipped.select(F.col("plan_id").alias("_plan"), F.col("step_number").alias("_step"), F.lit(True).alias("_skipped"))
    same = steps["plan_id"].eqNullSafe(F.col("_plan")) & steps["step_number"].eqNullSafe(F.col("_step"))
    joined = steps.join(named, same, "left")
    status = F.when(F.col("_skipped"), SKIPPED).otherwise(F.col("status"))
    return joined.withColumn("gated_status", status).drop("_plan", "_step", "_skipped")


# Flags of a step that was folded.
DONE, NOT_DONE, LEFT_OUT = (bytearray([i]) for i in range(3))


def _folded_skips(numbered: DataFrame) -> DataFrame:
    """``plan_id, step_number`` of the steps that are skipped, plan by plan in one fold."""
    row = F.struct("step_number", "bad", F.coalesce("needs", F.array()).alias("needs"))
    plans = numbered.groupBy("plan_id").agg(F.array_sort(F.collect_list(row)).alias("steps"))
    plans = plans.withColumn("numbers", F.transform("steps", lambda x: x["step_number"]))

    def flagged(flags: Column, x: Column) -> Column:
        def unmet(need: Column) -> Column:
            place = F.array_position("numbers", need)
            earlier = F.substring(flags, place.cast("int"), F.lit(1)) != F.lit(DONE)
            return (place > 0) & ((need >= x["step_number"]) | earlier)

        flag = F.when(F.exists(x["needs"], unmet), F.lit(LEFT_OUT)).when(x["bad"], F.lit(NOT_DONE)).otherwise(F.lit(DONE))
        return F.concat(flags, flag)

    flags = F.aggregate("steps", F.lit(bytearray()), flagged)
    plans = plans.select("plan_id", "numbers", flags.alias("flags"))
    each = plans.select("plan_id", "flags", F.posexplode("numbers").alias("_at", "step_number"))
    return each.filter(F.substring("flags", F.col("_at") + 1, F.lit(1)) == F.lit(LEFT_OUT)).select("plan_id", "step_number")


def _spread_skips(numbered: DataFrame) -> DataFrame:
    """The same, one round per link; a round reads only the links from steps found in the round before."""
    keys = ["plan_id", "step_number"]
    known = numbered.select("plan_id", F.col("step_number").alias("needs"))
    links = numbered.select(*keys, F.explode("needs").alias("needs"))
    links = materialise(links.join(known, ["plan_id", "needs"], "left_semi").select(*keys, "needs"), "gate-links")
    too_early = links.filter(F.col("needs") >= F.col("step_number")).select(*keys).distinct()
    links = links.filter(F.col("needs") < F.col("step_number"))
    frontier = materialise(numbered.filter("bad").select(*keys).unionAll(too_early).distinct(), "gate")
    reached, rounds = frontier, 0
    while True:  # a link leads to a later step, so this ends
        hit = links.join(frontier.withColumnRenamed("step_number", "needs"), ["plan_id", "needs"], "left_semi")
        frontier = materialise(hit.select(*keys).distinct().join(reached, keys, "left_anti"), "gate")
        if frontier.isEmpty():
            break
        reached, rounds = reached.unionAll(frontier), rounds + 1
        if rounds % FOLD_ROUNDS == 0:  # one table again, so that scans and plans stay small
            reached = materialise(reached, "gate")
    blocked = links.join(reached.withColumnRenamed("step_number", "needs"), ["plan_id", "needs"], "left_semi")
    return blocked.select(*keys).unionAll(too_early).distinct()


def output_head(output: Column) -> Column:
    """The first 200 characters, with an ellipsis where cut."""
    return F.when(
        F.length(output) > HEAD_LENGTH, F.concat(F.substring(output, 1, HEAD_LENGTH), F.lit("..."))
    ).otherwise(output)


def run_summary(steps: DataFrame) -> DataFrame:
    """The lines of each plan's summary: ``plan_id, line_number, line``.

    Line 0 counts the completed steps; then one line per step with the head of
    its output, numbered by the step. Lines stay rows, as a plan may have any
    number of them.
    """
    counts = steps.groupBy("plan_id").agg(
        F.count_if(F.col("status") == COMPLETED).alias("done"), F.count(F.lit(1)).alias("n")
    )
    first = counts.select(
        "plan_id",
        F.lit(0).cast("long").alias("line_number"),
        F.format_string("Migration plan completed: %d/%d steps successful.", "done", "n").alias("line"),
    )
    heads = steps.filter(F.col("output").isNotNull()).select(
        "plan_id",
        F.col("step_number").cast("long").alias("line_number"),
        F.concat(F.lit("**"), F.col("agent"), F.lit("**: "), output_head(F.col("output"))).alias("line"),
    )
    return first.unionAll(heads)


def param_filter(df: DataFrame, params: Mapping[str, object], partition: tuple[str, object] | None = None) -> DataFrame:
    """Rows equal to all parameters; NULL matches NULL.

    Names may start with @ and may be the short forms uid, pid and tid.
    ``partition`` is a column and its value, checked first.
    """
    out = df if partition is None else df.filter(F.col(partition[0]) == F.lit(partition[1]))
    for name, value in params.items():
        field = name.lstrip("@")
        out = out.filter(F.col(PARAMETER_FIELDS.get(field, field)).eqNullSafe(F.lit(value)))
    return out
