"""Structured Streaming jobs: alerts, de-duplication, expiry, incremental
copies, step state and merges.

Transformations take and return streaming (or batch) DataFrames; ``run_*``
functions start a query that stops when its input is used up and can be
started again from the same folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from drayage.operators.load import merge_upsert
from drayage.session import drop_folder, numbered_folders

# Windows and limits of the alerts, and of the message queues.
FAILURE_WINDOW, FAILURE_EVERY = "15 minutes", "5 minutes"
DURATION_WINDOW, DURATION_EVERY = "1 hour", "15 minutes"
MAX_DURATION_SECONDS = 14_400
DUPLICATE_WINDOW = "10 minutes"
MESSAGE_LIFETIME_DAYS = 7
MAX_DELIVERIES = 5


def event_time(df: DataFrame, column: str) -> DataFrame:
    """``column`` as a timestamp with zone, as watermarks require."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def failure_alerts(events: DataFrame, ts: str, failed: Column | str, delay: str = "10 minutes") -> DataFrame:
    """Windows of 15 minutes, every 5, that hold a failed run."""
    test = F.expr(failed) if isinstance(failed, str) else failed
    window = F.window(ts, FAILURE_WINDOW, FAILURE_EVERY)
    counted = event_time(events, ts).withWatermark(ts, delay).groupBy(window.alias("w"))
    found = counted.agg(F.count_if(test).alias("failed_runs"), F.count(F.lit(1)).alias("runs"))
    return found.filter("failed_runs > 0").select(*_bounds(), "failed_runs", "runs")


def duration_alerts(
    runs: DataFrame, ts: str, seconds: str, limit: float = MAX_DURATION_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """Windows of one hour, every 15 minutes, whose longest run is too long."""
    window = F.window(ts, DURATION_WINDOW, DURATION_EVERY)
    longest = event_time(runs, ts).withWatermark(ts, delay).groupBy(window.alias("w"))
    found = longest.agg(F.max(seconds).alias("max_seconds"), F.count(F.lit(1)).alias("runs"))
    return found.filter(F.col("max_seconds") > limit).select(*_bounds(), "max_seconds", "runs")


def _bounds() -> list[Column]:
    return [
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
    ]


# Keys of the first level of de-duplication that one key is dealt to.
SALTS = 32


def deduplicate(
    events: DataFrame, keys: Sequence[str], ts: str, within: str = DUPLICATE_WINDOW, salts: int = SALTS
) -> DataFrame:
    """Drop rows whose keys were seen less than ``within`` ago.

    On two levels, so that a key with many rows is no task of its own: first
    per key and task that read the row (modulo ``salts``), then per key, of which
    no more than ``salts`` rows are left per ``within``.
    """
    columns = events.columns
    timed = event_time(events, ts).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).withWatermark(ts, within)
    some = timed.dropDuplicatesWithinWatermark([*keys, "_salt"]) if salts > 1 else timed
    return some.dropDuplicatesWithinWatermark(list(keys)).select(*columns)


def count_deliveries(
    deliveries: DataFrame, key: str, enqueued: str, lifetime_days: int = MESSAGE_LIFETIME_DAYS
) -> DataFrame:
    """``enqueued, key, deliveries``: how often each message was delivered so far.

    A message keeps the time it was enqueued at, and that time is part of the
    key. So its count lives in the state until the watermark, ``lifetime_days``
    behind the newest message, has passed it: just as long as the message does.
    Deliveries are counted before the shuffle.
    """
    timed = event_time(deliveries, enqueued).withWatermark(enqueued, f"{lifetime_days} days")
    return timed.groupBy(enqueued, key).agg(F.count(F.lit(1)).alias("deliveries"))


def run_deliveries(
    deliveries: DataFrame,
    folder: str,
    checkpoint: str,
    key: str,
    enqueued: str,
    as_of: Column,
    max_deliveries: int = MAX_DELIVERIES,
    lifetime_days: int = MESSAGE_LIFETIME_DAYS,
) -> DataFrame:
    """Count the deliveries of a stream and route its messages; returns the messages delivered so far.

    ``key, enqueued, deliveries, route``: expired messages are told by ``as_of``
    and not counted; the others are dead-lettered once they were delivered more
    than ``max_deliveries`` times. Each batch writes the messages it delivers, and a
    repeated batch replaces itself. ``as_of`` must not lie before the newest message.
    """
    spark = deliveries.sparkSession
    oldest = as_of.cast("timestamp") - F.make_dt_interval(F.lit(lifetime_days))
    old = F.col(enqueued).cast("timestamp") < oldest
    expired = event_time(deliveries.filter(old), enqueued).select(key, enqueued)

    def write_expired(batch: DataFrame, batch_id: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{folder}/expired/batch={batch_id}")

    def write_live(batch: DataFrame, batch_id: int) -> None:
        batch.select(key, enqueued, "deliveries").write.mode("overwrite").parquet(f"{folder}/live/batch={batch_id}")

    run_batches(expired, write_expired, f"{checkpoint}/expired")
    run_batches(count_deliveries(deliveries.filter(~old), key, enqueued, lifetime_days), write_live, f"{checkpoint}/live", "update")

    def written(part: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{folder}/{part}/batch=*")
        except AnalysisException:  # no batch had any
            return spark.createDataFrame([], schema)

    kind = deliveries.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, `{enqueued}` timestamp"
    live = written("live", f"{fields}, deliveries long").groupBy(key, enqueued).agg(F.max("deliveries").alias("deliveries"))
    route = F.when(F.col("deliveries") > max_deliveries, "max_deliveries").otherwise("live")
    gone = written("expired", fields).distinct().select(key, enqueued, F.lit(None).cast("long"), F.lit("expired"))
    return live.select(key, enqueued, "deliveries", route.alias("route")).unionAll(gone)


def route_messages(
    messages: DataFrame, ts: str, as_of: Column, deliveries: str, lifetime_days: int = MESSAGE_LIFETIME_DAYS
) -> DataFrame:
    """Add ``route``: live, or dead-lettered as expired or over-delivered."""
    age = as_of.cast("timestamp") - F.make_dt_interval(F.lit(lifetime_days))
    return messages.withColumn(
        "route",
        F.when(F.col(ts).cast("timestamp") < age, "expired")
        .when(F.col(deliveries) > MAX_DELIVERIES, "max_deliveries")
        .otherwise("live"),
    )


def step_state(messages: DataFrame, ts: str, keys: Sequence[str] = ("plan_id", "step_number")) -> DataFrame:
    """Latest status and running token sum per step.

    Messages of one time are ordered by ``message_id``.
    """
    order = F.struct(F.col(ts), F.col("message_id"))
    return messages.groupBy(*keys).agg(
        F.max_by("status", order).alias("status"),
        F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("message_count"),
    )


def _available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a query over what is there now.

    Its state has as many parts as the session has shuffle partitions when the
    first run of a checkpoint starts.
    """
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append the stream's rows to Parquet, each once; returns the table."""
    _available(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Hand each micro-batch to ``write``, which must be repeatable."""
    _available(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint)


def run_routed(stream: DataFrame, folder: str, checkpoint: str, route: str = "route") -> DataFrame:
    """Write each route to its own folder; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy(route).parquet(
            f"{folder}/batch={batch_id}"
        )

    run_batches(stream, write, checkpoint)
    return stream.sparkSession.read.parquet(f"{folder}/batch=*")


# Batches after which a job folds what it has written, and drops what the fold before that made useless.
COMPACT_EVERY = 16


def _notes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The notes of a job since it last folded them; none before the first."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/notes/*")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _note(spark: SparkSession, folder: str, batch_id: int, rows: list, schema: str, name: str = "batch") -> None:
    """Notes of a batch, written when its data is; a repeated batch replaces them."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/notes/{name}={batch_id}")


def _drop_older(spark: SparkSession, folder: str, name: str, than: int) -> None:
    for number in numbered_folders(spark, folder, name):
        if number < than:
            drop_folder(spark, f"{folder}/{name}={number}")


def run_state(state: DataFrame, folder: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Write the changed groups of each batch; returns the newest per key.

    Every ``COMPACT_EVERY`` batches the newest rows so far are written as one
    table, so that a read never goes back further. What that table replaces
    stays until the next one, for results that still read it, and goes then.
    """
    spark, values = state.sparkSession, [c for c in state.columns if c not in keys]
    schema = state.withColumn("batch_id", F.lit(0)).schema

    def newest(upto: int | None) -> DataFrame:
        noted = _notes(spark, folder, "compact long")
        since = (noted if upto is None else noted.filter(F.col("compact") <= upto)).agg(F.max("compact")).first()[0]
        read = spark.read.schema(schema)
        changes = read.parquet(f"{folder}/batch=*").filter(F.col("batch_id") > (-1 if since is None else since))
        if upto is not None:
            changes = changes.filter(F.col("batch_id") <= upto)
        if since is not None:
            changes = changes.unionByName(read.parquet(f"{folder}/compact={since}"))
        latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values, "batch_id"), "batch_id").alias("v"))
        return latest.select(*keys, "v.*")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        if (batch_id + 1) % COMPACT_EVERY == 0:
            newest(batch_id).write.mode("overwrite").parquet(f"{folder}/compact={batch_id}")
            _note(spark, folder, batch_id, [(batch_id,)], "compact long")
            before = batch_id - COMPACT_EVERY
            _drop_older(spark, folder, "batch", before + 1)
            _drop_older(spark, folder, "compact", before)
            _drop_older(spark, f"{folder}/notes", "batch", before)

    run_batches(state, write, checkpoint, "update")
    return newest(None).drop("batch_id")


MERGED = "bucket int, version long, has_rows boolean"


def current_version(spark: SparkSession, folder: str) -> int | None:
    """The last batch that was merged whole; -1 if there is only the base, None before."""
    return _notes(spark, folder, MERGED).agg(F.max("version")).first()[0]


def bucket_versions(spark: SparkSession, folder: str, upto: int | None = None) -> dict[int, tuple[int, bool]]:
    """Per bucket the version that holds its rows, and whether there are any: a row per bucket."""
    notes = _notes(spark, folder, MERGED)
    notes = notes if upto is None else notes.filter(F.col("version") <= upto)
    last = notes.groupBy("bucket").agg(F.max(F.struct("version", "has_rows")).alias("v")).collect()
    return {r["bucket"]: tuple(r["v"]) for r in last}


def fold_versions(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Write which version each bucket has as one note, and drop notes and versions that the fold before had left behind."""
    now = bucket_versions(spark, folder)
    folds = numbered_folders(spark, f"{folder}/notes", "fold")
    _note(spark, folder, batch_id, [(b, v, full) for b, (v, full) in sorted(now.items())], MERGED, "fold")
    before = max((f for f in folds if f < batch_id), default=None)
    if before is None:
        return
    kept = {b: {v, now[b][0]} for b, (v, _) in bucket_versions(spark, folder, before).items()}
    for version in numbered_folders(spark, folder, "version"):
        if version <= before:
            path = f"{folder}/version={version}"
            held = numbered_folders(spark, path, "bucket")
            dead = [b for b in held if version not in kept.get(b, ())]
            for b in dead:
                drop_folder(spark, f"{path}/bucket={b}")
            if len(dead) == len(held):
                drop_folder(spark, path)
    for name in ("batch", "fold"):
        _drop_older(spark, f"{folder}/notes", name, before)


def run_merge(
    changes: DataFrame,
    base: DataFrame,
    folder: str,
    checkpoint: str,
    keys: Sequence[str],
    sequence: str,
    action: str = "row_action",
    buckets: int = 64,
) -> DataFrame:
    """Apply a stream of change rows to a table; returns the table after the last batch.

    Rows lie in ``buckets`` folders by a hash of their keys. A batch rewrites
    the buckets that it touches, data first and their versions second, so a batch
    that is repeated after a failure ends in the same versions. Every
    ``COMPACT_EVERY`` batches the versions are noted as one, and those that were
    out of date at the note before are dropped. The first run
    copies ``base``; the number of buckets must stay the same.
    """
    spark, schema = changes.sparkSession, base.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def read(versions: dict[int, tuple[int, bool]], wanted: set[int]) -> DataFrame:
        paths = [f"{folder}/version={v}/bucket={b}" for b, (v, full) in versions.items() if full and b in wanted]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def store(rows: DataFrame, version: int, touched: set[int]) -> None:
        path = f"{folder}/version={version}"
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        try:
            full = {r["bucket"] for r in spark.read.parquet(path).select("bucket").distinct().collect()}
        except AnalysisException:  # no row is left
            full = set()
        _note(spark, folder, version, [(b, version, b in full) for b in sorted(touched)], MERGED)

    def write(batch: DataFrame, batch_id: int) -> None:
        if current_version(spark, folder) >= batch_id:
            return  # done before the failure
        held = batch.persist()
        touched = {r["bucket"] for r in held.select(bucket.alias("bucket")).distinct().collect()}  # as many as buckets
        if touched:
            store(merge_upsert(read(bucket_versions(spark, folder), touched), held, keys, sequence, action), batch_id, touched)
        held.unpersist()
        if (batch_id + 1) % COMPACT_EVERY == 0:
            fold_versions(spark, folder, batch_id)

    everything = set(range(buckets))
    if current_version(spark, folder) is None:
        store(base, -1, everything)
    run_batches(changes, write, checkpoint)
    return read(bucket_versions(spark, folder), everything)
