"""Loads: incremental by watermark, history, keyed merge, change-log replay
and parallel copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drayage.functions.canonical import raw_cells, row_hash
from drayage.operators.ordering import in_order, neighbour
from drayage.session import materialise

STATE_SCHEMA = "table_name string, batch_id long, watermark_value timestamp_ntz"
FIRST_WATERMARK = "1900-01-01 00:00:00"
STATUS_SCHEMA = "table_name string, status string, row_count long, message string"


def watermark(spark: SparkSession, state_path: str, table: str) -> tuple[int, str]:
    """Last batch and watermark of a table; batch 0 at 1900 if never loaded.

    Each table keeps its state in a folder of its own, so that tables can be
    loaded side by side.
    """
    try:
        state = spark.read.schema(STATE_SCHEMA).parquet(f"{state_path}/{table}")
    except AnalysisException:  # no state written yet
        return 0, FIRST_WATERMARK
    row = (
        state.agg(
            F.max("batch_id").alias("batch"), F.max_by("watermark_value", "batch_id").cast("string").alias("value")
        ).first()
    )
    return (0, FIRST_WATERMARK) if row["batch"] is None else (row["batch"], row["value"])


LEDGER_SCHEMA = "cells string, held long"


def _ledger_path(state_path: str, table: str, batch: int) -> str:
    return f"{state_path}/ledger/{table}/batch_id={batch}"


def _ledger(rows: DataFrame, target_path: str, state_path: str, table: str, batch: int, at_mark: Column) -> DataFrame:
    """``cells, held``: the different rows at the watermark after ``batch`` and how often they are held.

    A state from before ledgers were kept has none; then the batches are read.
    """
    spark = rows.sparkSession
    path = _ledger_path(state_path, table, batch)
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException:  # no ledger written
        loaded = spark.read.schema(rows.schema).parquet(*[f"{target_path}/batch_id={i}" for i in range(1, batch + 1)])
        return _tied(loaded.filter(at_mark))


def _tied(rows: DataFrame) -> DataFrame:
    return rows.groupBy(xxhash(rows.columns).alias("cells")).agg(F.count(F.lit(1)).alias("held"))


def _not_held(tied: DataFrame, ledger: DataFrame) -> DataFrame:
    """``tied`` without what the ledger holds, each row as often as it does.

    Equal rows are counted before the shuffle, so that many of them are one.
    """
    columns = tied.columns
    counted = tied.groupBy(xxhash(columns).alias("cells")).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row")
    )
    left = counted.join(ledger, "cells", "left").withColumn("_n", F.col("_n") - F.coalesce("held", F.lit(0)))
    copies = left.filter("_n > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return copies.select("_row.*")


def xxhash(columns: Sequence[str]) -> Column:
    """128 bits of a row's cells, as text."""
    cells = [F.col(f"`{c}`") for c in columns]
    present = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cells])
    return F.concat_ws(" ", F.hex(F.xxhash64(present, *cells)), F.hex(F.xxhash64(F.lit(1), present, *cells)))


def incremental_load(source: DataFrame, target_path: str, state_path: str, table: str, modified: str) -> int:
    """Append the rows modified since the last load; returns the batch.

    The new watermark is the largest value in the rows copied, found as they
    are written. The source is read from the watermark on, with the filter
    pushed to its files. Rows *at* the old watermark may have come later: they
    are loaded too, but for those already held. Which those are is kept next to
    the state, as a hash and a count per different row at the watermark, so that
    no load reads earlier batches. Rows without a value are counted in the same
    scan; only if there are some are they read and kept in
    ``state_path/rejects/table``, which each load writes anew. Data goes first,
    then the ledger, then the state; a run that died in between, or found
    nothing, is repeated into the same batch folder.
    """
    spark = source.sparkSession
    batch, value = watermark(spark, state_path, table)
    stamp, mark = F.col(modified).cast("timestamp_ntz"), F.lit(value).cast("timestamp_ntz")
    wanted = stamp.isNull() | (stamp >= mark) if batch else F.lit(True)  # goes down to the files
    seen, rejected = Observation(f"load-{table}"), Observation(f"rejects-{table}")
    read = source.filter(wanted).observe(rejected, F.count_if(stamp.isNull()).alias("n")).filter(stamp.isNotNull())
    ledger = _ledger(source, target_path, state_path, table, batch, stamp == mark) if batch else None
    fresh = read
    if batch:
        # Rows after the watermark pass as they are, the few at it are counted first.
        fresh = read.filter(stamp > mark).unionAll(_not_held(source.filter(stamp == mark), ledger))
    told = fresh.observe(seen, F.count(F.lit(1)).alias("n"), F.max(stamp).cast("string").alias("upper"))
    path = f"{target_path}/batch_id={batch + 1}"
    told.write.mode("overwrite").parquet(path)
    rejects = source.filter(stamp.isNull()) if rejected.get["n"] else source.limit(0)
    rejects.write.mode("overwrite").parquet(f"{state_path}/rejects/{table}")
    if not seen.get["n"]:
        return batch
    upper = F.lit(seen.get["upper"]).cast("timestamp_ntz")
    held = _tied(spark.read.schema(source.schema).parquet(path).filter(stamp == upper))
    if ledger is not None and spark.range(1).select(upper == mark).first()[0]:  # only rows at the old watermark came
        held = held.unionAll(ledger).groupBy("cells").agg(F.sum("held").alias("held"))
    held.write.mode("overwrite").parquet(_ledger_path(state_path, table, batch + 1))
    state = spark.createDataFrame([(table, batch + 1, seen.get["upper"])], "table_name string, batch_id long, value string")
    state = state.select("table_name", "batch_id", F.col("value").cast("timestamp_ntz").alias("watermark_value"))
    state.write.mode("append").parquet(f"{state_path}/{table}")
    return batch + 1


def incremental_load_tables(
    sources: Mapping[str, tuple[DataFrame, str]], target_folder: str, state_path: str, parallel: int = 4
) -> dict[str, int]:
    """:func:`incremental_load` for ``{table: (source, modified column)}``.

    ``parallel`` tables at a time; returns the batch each one is at.
    """
    spark = next(iter(sources.values()))[0].sparkSession

    def load(table: str) -> int:
        source, modified = sources[table]
        return incremental_load(source, f"{target_folder}/{table}", state_path, table, modified)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return dict(zip(sources, pool.map(inheritable_thread_target(spark)(load), sources)))


def scd2_history(
    changes: DataFrame, keys: Sequence[str], tracked: Sequence[str], effective: str, sequence: str
) -> DataFrame:
    """Type-2 history: one row per run of unchanged ``tracked`` values.

    ``valid_from`` is the first ``effective`` value of the run, ``valid_to`` that
    of the next run (NULL while current). ``sequence`` orders changes at the
    same time. Changes are put in order by range, and work runs per range
    partition, so that a key's changes need not fit one task.
    """
    versions = changes.select(
        *keys, *tracked, F.col(effective).alias("valid_from"), F.col(sequence).alias("_sequence")
    )
    versions = versions.withColumn("_hash", row_hash(raw_cells(versions, tracked)))
    ordered = in_order(versions, [*keys, "valid_from", "_sequence"], "scd2")
    compared = neighbour(ordered, keys, {"_hash": "_before"}, previous=True, found="_has_before")
    opened = compared.filter(~F.col("_has_before") | (F.col("_hash") != F.col("_before")))
    runs = materialise(opened, "scd2")
    closed = neighbour(runs, keys, {"valid_from": "valid_to"}, previous=False, found="_has_next")
    return closed.select(*keys, *tracked, "valid_from", "valid_to", (~F.col("_has_next")).alias("is_current"))


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Whether the keys are equal, NULL keys too; the right ones bear a prefix."""
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return same


def _keys_named(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


def _in_sequence(df: DataFrame, sequence: str, action: str) -> Column:
    """The order of changes; those with one sequence go by their cells."""
    rest = [c for c in df.columns if c not in (sequence, action)]
    return F.struct(F.col(sequence), F.col(action), F.xxhash64(*[f"`{c}`" for c in rest]))


def _folded(changes: DataFrame, columns: Sequence[str], keys: Sequence[str], sequence: str, action: str) -> DataFrame:
    """What a key's changes, in order, come to: a row per key.

    ``_deleted``: whether one of them deletes. Of the changes after the last
    delete: ``_first`` and its place ``_first_at``, the first that can make a
    row, and ``_last``, ``_last_at``, the last that can change one. All are
    minima and maxima, so a key may have any number of changes.
    """
    ordered = changes.withColumn("_at", _in_sequence(changes, sequence, action))
    deletes = ordered.filter(F.col(action) == "delete").groupBy(*keys).agg(F.max("_at").alias("_delete"))
    deletes = _keys_named(materialise(deletes, "merge-deletes"), keys, "_d_")
    joined = ordered.join(deletes, _same_keys(ordered, deletes, keys, "_d_"), "left")
    later = F.col("_delete").isNull() | (F.col("_at") > F.col("_delete"))
    makes = later & F.col(action).isin("insert", "upsert")
    sets = later & F.col(action).isin("update", "upsert")
    row = F.struct(*[f"`{c}`" for c in columns])
    return joined.groupBy(*[ordered[k] for k in keys]).agg(
        F.max(F.col("_delete").isNotNull()).alias("_deleted"),
        F.min(F.when(makes, F.col("_at"))).alias("_first_at"),
        F.min_by(row, F.when(makes, F.col("_at"))).alias("_first"),
        F.max(F.when(sets, F.col("_at"))).alias("_last_at"),
        F.max_by(row, F.when(sets, F.col("_at"))).alias("_last"),
    )


def merge_upsert(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str, action: str = "row_action"
) -> DataFrame:
    """The target after each key's changes, applied in order: insert, update, upsert, delete.

    An insert of a key that is present then, and an update or delete of one
    that is absent, do nothing (:func:`merge_conflicts` lists them). The result
    is the same wherever the changes are cut into batches. NULL keys are equal;
    the target's keys should be unique. Write the result to a new path: the target
    is read while the result is made.
    """
    columns = target.columns
    folded = _keys_named(_folded(changes, columns, keys, sequence, action), keys, "_f_")
    folded = folded.withColumn("_changed", F.lit(True))
    held = target.withColumn("_row", F.struct(*[f"`{c}`" for c in columns]))
    joined = held.join(folded, _same_keys(held, folded, keys, "_f_"), "full_outer")
    made = F.when(F.col("_last_at") >= F.col("_first_at"), F.col("_last")).otherwise(F.col("_first"))
    outcome = (
        F.when(F.col("_changed").isNull(), F.col("_row"))
        .when(F.col("_row").isNotNull() & ~F.col("_deleted"), F.coalesce("_last", "_row"))
        .when(F.col("_first_at").isNotNull(), made)
    )
    return joined.select(outcome.alias("_row")).filter(F.col("_row").isNotNull()).select("_row.*")


def merge_conflicts(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str, action: str = "row_action"
) -> DataFrame:
    """Changes that do nothing when their turn comes: ``keys``, the sequence and the action.

    Whether a key is present then follows from its last insert, upsert or
    delete before, or else from the target. Changes are put in order by range,
    so a key's changes need not fit one task.
    """
    settles = F.col(action).isin("insert", "upsert", "delete")
    ordered = in_order(changes.withColumn("_at", _in_sequence(changes, sequence, action)), [*keys, "_at"], "merge-order")
    before = neighbour(ordered, keys, {action: "_before"}, previous=True, found="_settled", marked=settles)
    present = _keys_named(target.select(*keys).distinct().withColumn("_present", F.lit(True)), keys, "_t_")
    joined = before.join(present, _same_keys(before, present, keys, "_t_"), "left")
    there = F.when(F.col("_settled"), F.col("_before") != "delete").otherwise(F.col("_present").isNotNull())
    idle = F.when(F.col(action) == "insert", there).when(F.col(action).isin("update", "delete"), ~there).otherwise(F.lit(False))
    return joined.filter(idle).select(*keys, sequence, action)


def changelog_replay(
    log: DataFrame,
    record: Sequence[str],
    sequence: str,
    event: str = "event_type",
    new_values: str = "new_values",
) -> DataFrame:
    """State of each record: ``alive``, and a row per ``field, value`` if it is.

    INSERT starts a record anew, UPDATE overwrites the fields it names, DELETE
    ends it: what comes between a DELETE and the next INSERT does nothing. A
    record that is dead, or has no fields, has one row without a field. Only the
    last write per field matters, so everything is a combinable maximum and a
    record may have any number of events.
    """
    kind = F.upper(event)
    life = log.groupBy(*record).agg(
        F.max(F.when(kind == "INSERT", F.col(sequence))).alias("_born"),
        F.max(F.when(kind == "DELETE", F.col(sequence))).alias("_died"),
    )
    alive = F.col("_died").isNull() | F.coalesce(F.col("_born") > F.col("_died"), F.lit(False))
    life = life.withColumn("alive", alive)
    values = F.from_json(new_values, "map<string,string>")
    writes = log.filter(kind != "DELETE").select(
        *record, F.col(sequence).alias("_sequence"), F.explode(values).alias("field", "value")
    )
    fields = writes.groupBy(*record, "field").agg(
        F.max_by("value", "_sequence").alias("value"), F.max("_sequence").alias("_sequence")
    )
    fields = _keys_named(fields, record, "_w_")
    current = _same_keys(life, fields, record, "_w_") & life["alive"] & (life["_born"].isNull() | (fields["_sequence"] >= life["_born"]))
    return life.join(fields, current, "left").select(*record, "alive", "field", "value")


def load_table(df: DataFrame, path: str, name: str) -> DataFrame:
    """Write a table once; a status row says loaded, exists or failed."""
    observed = Observation(f"load-{name}")
    counted = df.observe(observed, F.count(F.lit(1)).alias("n"))
    try:
        counted.write.mode("errorifexists").parquet(path)
        row = (name, "loaded", observed.get["n"], None)
    except AnalysisException as error:
        exists = error.getCondition() == "PATH_ALREADY_EXISTS"
        row = (name, "exists" if exists else "failed", None, str(error).split("\n")[0])
    return df.sparkSession.createDataFrame([row], STATUS_SCHEMA)


def copy_tables(tables: Mapping[str, DataFrame], folder: str, parallel: int = 4) -> DataFrame:
    """Copy each table to ``folder/name``, ``parallel`` at a time.

    One independent Spark job per table. Rows are counted as they are written;
    a table that fails does not stop the others.
    """
    spark = next(iter(tables.values())).sparkSession

    def copy(name: str, df: DataFrame) -> tuple:
        observed = Observation(f"copy-{name}")
        try:
            df.observe(observed, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}")
            return (name, "copied", observed.get["n"], None)
        except Exception as error:  # the status row carries it
            return (name, "failed", None, str(error).split("\n")[0])

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        work = inheritable_thread_target(spark)(copy)
        rows = list(pool.map(work, tables.keys(), tables.values()))
    return spark.createDataFrame(rows, STATUS_SCHEMA)
