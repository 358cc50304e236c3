from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from frames import rows
from pyspark.sql import functions as F

from drayage.streaming import jobs

START = datetime(2024, 1, 1)


def events(spark, *minutes_and_types):
    data = [(i, START + timedelta(minutes=m), k) for i, (m, k) in enumerate(minutes_and_types)]
    return spark.createDataFrame(data, "event_id int, ts timestamp_ntz, event_type string")


def arriving(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_alerts_only_from_closed_windows_and_across_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(*batch):
        df = events(spark, *batch)
        df.write.mode("append").parquet(source)
        alerts = jobs.failure_alerts(arriving(spark, source, df.schema), "ts", "event_type = 'error'")
        return jobs.run_append(alerts, out, checkpoint)

    assert run((1, "error"), (2, "click")).isEmpty()  # still open
    got = rows(run((40, "click")))
    assert got == [
        (START - timedelta(minutes=10), START + timedelta(minutes=5), 1, 2),
        (START - timedelta(minutes=5), START + timedelta(minutes=10), 1, 2),
        (START, START + timedelta(minutes=15), 1, 2),
    ]
    late = rows(run((3, "error"), (200, "click")))  # behind the watermark: dropped
    assert late == got


def test_long_runs(spark):
    df = spark.createDataFrame([(START, 14_400.0), (START + timedelta(hours=3), 14_401.0)], "ts timestamp_ntz, s double")
    got = jobs.duration_alerts(df, "ts", "s")  # the same code on a batch
    assert got.count() == 4 and got.agg(F.min("max_seconds")).first()[0] == 14_401.0


def test_duplicates_across_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "event_id int, ts timestamp_ntz"

    def run(*pairs):
        df = spark.createDataFrame([(i, START + timedelta(minutes=m)) for i, m in pairs], schema)
        df.write.mode("append").parquet(source)
        unique = jobs.deduplicate(arriving(spark, source, df.schema), ["event_id"], "ts")
        return jobs.run_append(unique, out, checkpoint).count()

    assert run((1, 0), (1, 1), (2, 0)) == 2
    assert run((1, 5), (3, 6)) == 3
    assert run((4, 60)) == 4
    assert run((1, 61)) == 5  # long after the first one: a new message


def test_routes(spark):
    df = spark.createDataFrame([(1, START, 1), (2, START + timedelta(days=9), 6), (3, START + timedelta(days=9), 5)], "id int, ts timestamp_ntz, n int")
    as_of = F.lit(START + timedelta(days=10)).cast("timestamp")
    assert rows(jobs.route_messages(df, "ts", as_of, "n"), "id", "route") == [(1, "expired"), (2, "max_deliveries"), (3, "live")]


def test_step_state_over_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "plan_id int, step_number int, message_id int, ts int, status string, tokens int"

    def run(*data):
        df = spark.createDataFrame(list(data), schema)
        df.write.mode("append").parquet(source)
        state = jobs.step_state(arriving(spark, source, df.schema), "ts")
        return rows(jobs.run_state(state, out, checkpoint, ["plan_id", "step_number"]))

    assert run((1, 1, 1, 10, "in_progress", 5), (1, 2, 2, 10, "pending", 0)) == [(1, 1, "in_progress", 5, 1), (1, 2, "pending", 0, 1)]
    assert run((1, 1, 3, 20, "completed", 7)) == [(1, 1, "completed", 12, 2), (1, 2, "pending", 0, 1)]


CHANGE = "id int, v string, seq int, row_action string"


def test_merge_over_batches_and_a_repeated_batch(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")

    def run(*changes):
        df = spark.createDataFrame(list(changes), CHANGE)
        df.write.mode("append").parquet(source)
        return rows(jobs.run_merge(arriving(spark, source, df.schema), base, out, checkpoint, ["id"], "seq"))

    assert run((1, "x", 1, "update"), (3, "c", 1, "insert")) == [(1, "x"), (2, "b"), (3, "c")]
    assert run((2, None, 2, "delete"), (1, "y", 2, "upsert")) == [(1, "y"), (3, "c")]
    assert jobs.current_version(spark, out) == 1
    # A new checkpoint replays both files as batch 0, which is already merged.
    stream = arriving(spark, source, spark.createDataFrame([], CHANGE).schema)
    again = jobs.run_merge(stream, base, out, str(tmp_path / "second"), ["id"], "seq")
    assert rows(again) == [(1, "y"), (3, "c")]


def test_a_merge_rewrites_the_buckets_it_touches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    base = spark.range(200).selectExpr("cast(id AS int) AS id", "'old' AS v")
    df = spark.createDataFrame([(5, "new", 1, "update")], CHANGE)
    df.write.parquet(source)
    merged = jobs.run_merge(arriving(spark, source, df.schema), base, out, checkpoint, ["id"], "seq", buckets=8)
    assert merged.count() == 200 and rows(merged.filter("v = 'new'")) == [(5, "new")]
    assert len(os.listdir(f"{out}/version=-1")) > 8 and sum(n.startswith("bucket=") for n in os.listdir(f"{out}/version=0")) == 1


def test_state_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "plan_id int, step_number int, message_id int, ts timestamp_ntz, status string, tokens long"
    for i in range(5):
        at = START + timedelta(minutes=i)
        df = spark.createDataFrame([(1, 1, i, at, f"s{i}", 1), (1, i + 2, i, at, "x", 1)], schema)
        df.write.mode("append").parquet(source)
        got = rows(jobs.run_state(jobs.step_state(arriving(spark, source, df.schema), "ts"), out, checkpoint, ["plan_id", "step_number"]))
        assert got == sorted([(1, 1, f"s{i}", i + 1, i + 1), *((1, k + 2, "x", 1, 1) for k in range(i + 1))], key=repr)
    assert any(n.startswith("compact=") for n in os.listdir(out))


def test_a_failed_batch_is_repeated(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    df = events(spark, (0, "a"), (1, "b"))
    df.write.parquet(source)
    calls = []

    def flaky(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        jobs.run_batches(arriving(spark, source, df.schema), flaky, checkpoint)
    jobs.run_batches(arriving(spark, source, df.schema), flaky, checkpoint)
    assert calls == [0, 0]
    assert spark.read.parquet(f"{out}/batch=*").count() == 2


def test_deliveries_are_counted_over_batches_and_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    days = {1: 30, 2: 29, 3: 20, 4: 1}  # message: day it was enqueued
    seen = []

    def run(*ids, most=2):
        seen.extend(ids)
        df = spark.createDataFrame([(i, START + timedelta(days=days[i])) for i in ids], "id int, at timestamp_ntz")
        df.write.mode("append").parquet(source)
        as_of = F.lit(START + timedelta(days=31))
        got = jobs.run_deliveries(arriving(spark, source, df.schema), out, checkpoint, "id", "at", as_of, most, 14)
        return rows(got, "id", "deliveries", "route")

    assert run(1, 1, 2, 4) == [(1, 2, "live"), (2, 1, "live"), (4, None, "expired")]
    assert run(1, 3) == [(1, 3, "max_deliveries"), (2, 1, "live"), (3, 1, "live"), (4, None, "expired")]
    got = run(3, 3, 3, 2, 4)
    assert got == [(1, 3, "max_deliveries"), (2, 2, "live"), (3, 4, "max_deliveries"), (4, None, "expired")]
    assert {i: n for i, n, _ in got} == {i: seen.count(i) if i != 4 else None for i in days}


def test_a_hot_message_is_no_task_of_its_own(spark, tmp_path):
    """A third of the rows have one id: after the first level no task holds more than its share."""
    source = str(tmp_path / "in")
    hot = spark.range(3000, numPartitions=12).selectExpr("if(id % 3 = 0, -1, id) AS event_id", "timestamp_ntz '2024-01-01' AS ts")
    hot.write.parquet(source)
    unique = jobs.deduplicate(arriving(spark, source, hot.schema), ["event_id"], "ts")
    assert jobs.run_append(unique, str(tmp_path / "out"), str(tmp_path / "checkpoint")).count() == 2001
    first = hot.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(jobs.SALTS)))
    assert first.groupBy("event_id", "_salt").count().agg(F.max("count")).first()[0] <= 3000 / 12


def test_a_long_merge_keeps_few_notes_and_no_dead_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    base = spark.createDataFrame([(i, 0) for i in range(8)], "id int, v int")
    want, held = {i: 0 for i in range(8)}, []
    for turn in range(7):
        batch = [(turn, 10 + turn, "upsert", turn), (100 + turn, turn, "upsert", turn), (7 - turn, 0, "delete", 100 + turn)]
        df = spark.createDataFrame(batch, "id int, v int, row_action string, seq int")
        df.write.mode("append").parquet(source)
        merged = jobs.run_merge(arriving(spark, source, df.schema), base, out, checkpoint, ["id"], "seq", buckets=4)
        want |= {turn: 10 + turn, 100 + turn: turn}
        want.pop(7 - turn, None)
        assert rows(merged) == sorted(want.items(), key=repr)
        held.append(merged)
        notes = [n for kind in ("batch", "fold") for n in jobs.numbered_folders(spark, f"{out}/notes", kind)]
        assert len(notes) <= 8
    assert rows(held[-2]) != rows(held[-1])  # a result of one batch before can still be read
    versions = jobs.bucket_versions(spark, out)
    alive = [(v, b) for v in jobs.numbered_folders(spark, out, "version") for b in jobs.numbered_folders(spark, f"{out}/version={v}", "bucket")]
    assert set((v, b) for b, (v, full) in versions.items() if full) <= set(alive) and len(alive) <= 4 * 5


def test_long_step_state_drops_what_was_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "plan_id int, step_number int, status string, tokens int, message_id int, ts timestamp_ntz"
    for turn in range(9):
        spark.createDataFrame([(1, turn % 3, f"s{turn}", 1, turn, START + timedelta(minutes=turn))], schema).write.mode("append").parquet(source)
        stream = arriving(spark, source, spark.read.parquet(source).schema)
        got = rows(jobs.run_state(jobs.step_state(stream, "ts"), out, checkpoint, ["plan_id", "step_number"]), "step_number", "status", "message_count")
        assert got == [(n, f"s{turn - (turn - n) % 3}", (turn - n) // 3 + 1) for n in range(min(3, turn + 1))]
        assert len(jobs.numbered_folders(spark, out, "batch")) <= 4 and len(jobs.numbered_folders(spark, out, "compact")) <= 2
