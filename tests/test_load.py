from __future__ import annotations

import random

import pytest
import shop
from frames import plan, rows
from pyspark.sql import functions as F

from drayage.operators import load
from drayage.operators.dataflow import first_per_key
from drayage.operators.ordering import in_order, neighbour


def stamped(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id int, day string").select("id", F.expr("cast(day AS timestamp_ntz)").alias("m"))


def test_incremental_load(spark, tmp_path):
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    first = stamped(spark, (1, "2024-01-01"), (2, "2024-01-02"))
    assert load.watermark(spark, state, "t") == (0, "1900-01-01 00:00:00")
    assert load.incremental_load(first, target, state, "t", "m") == 1
    assert load.incremental_load(first, target, state, "t", "m") == 1  # nothing new
    later = first.unionAll(stamped(spark, (3, "2024-01-03")))
    assert load.incremental_load(later, target, state, "t", "m") == 2
    assert rows(spark.read.parquet(target), "id", "batch_id") == [(1, 1), (2, 1), (3, 2)]
    assert load.watermark(spark, state, "other") == (0, "1900-01-01 00:00:00")


def test_a_batch_that_died_before_its_state_is_repeated_in_place(spark, tmp_path):
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    source = stamped(spark, (1, "2024-01-01"), (2, "2024-01-02"))
    source.write.parquet(f"{target}/batch_id=1")  # written, but no state row
    load.incremental_load(source, target, state, "t", "m")
    assert rows(spark.read.parquet(target), "id") == [(1,), (2,)]


def test_rows_at_the_watermark_and_without_a_stamp(spark, tmp_path):
    """A row that comes later with the largest stamp seen is loaded, each row once."""
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    day = "2024-01-02"
    runs = [
        [(1, "2024-01-01"), (2, day)],
        [(1, "2024-01-01"), (2, day), (3, day), (4, None)],
        [(1, "2024-01-01"), (2, day), (3, day), (3, day), (4, None), (5, None), (6, "2024-01-03")],
    ]
    for i, source in enumerate([*runs, runs[-1]]):
        assert load.incremental_load(stamped(spark, *source), target, state, "t", "m") == min(i + 1, 3)
    assert rows(spark.read.parquet(target), "id", "batch_id") == [(1, 1), (2, 1), (3, 2), (3, 3), (6, 3)]
    assert rows(spark.read.parquet(f"{state}/rejects/t"), "id") == [(4,), (5,)]


def test_many_loads_at_one_watermark_and_no_old_batch_is_read(spark, tmp_path):
    """Rows keep coming with the same stamp; earlier batches are gone, the ledger is enough."""
    target, state, source = str(tmp_path / "target"), str(tmp_path / "state"), []
    day = "2024-01-02"
    rng = random.Random(3)
    for turn in range(5):
        source += [(rng.randrange(4), day) for _ in range(6)] + [(None, day)]
        assert load.incremental_load(stamped(spark, *source), target, state, "t", "m") == turn + 1
        loaded = [r for b in range(1, turn + 2) for r in rows(spark.read.parquet(f"{tmp_path}/target/batch_id={b}"), "id")]
        assert sorted(loaded, key=repr) == sorted([(i,) for i, _ in source], key=repr)
    ledger = load._ledger(stamped(spark, *source), "nowhere", state, "t", 5, F.lit(True))
    assert ledger.agg(F.sum("held")).first()[0] == len(source)
    assert "nowhere" not in plan(load._not_held(stamped(spark, *source), ledger))
    source += [(9, "2024-01-03")]
    assert load.incremental_load(stamped(spark, *source), target, state, "t", "m") == 6
    assert load._ledger(stamped(spark, *source), "nowhere", state, "t", 6, F.lit(True)).count() == 1


def test_a_state_without_a_ledger_is_read_from_the_batches(spark, tmp_path):
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    first = stamped(spark, (1, "2024-01-01"), (2, "2024-01-02"))
    load.incremental_load(first, target, state, "t", "m")
    old = load._ledger(first, target, str(tmp_path / "none"), "t", 1, F.col("m") == F.expr("timestamp_ntz '2024-01-02'"))
    assert rows(old) == rows(load._ledger(first, target, state, "t", 1, F.lit(True)))


def test_a_first_load_takes_rows_of_any_age(spark, tmp_path):
    source = stamped(spark, (1, "1850-01-01"), (2, "2024-01-02"))
    load.incremental_load(source, str(tmp_path / "t"), str(tmp_path / "s"), "t", "m")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def brute_history(changes):
    out, by_key = [], {}
    for key, when, seq, value in sorted(changes, key=lambda c: (c[0] or 0, c[1], c[2])):
        by_key.setdefault(key, []).append((when, value))
    for key, versions in by_key.items():
        runs = [v for i, v in enumerate(versions) if i == 0 or versions[i - 1][1] != v[1]]
        for i, (when, value) in enumerate(runs):
            end = runs[i + 1][0] if i + 1 < len(runs) else None
            out.append((key, value, when, end, end is None))
    return sorted(out, key=repr)


def test_history_matches_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    changes = [
        (None if rng.random() < 0.35 else rng.randrange(2, 200), rng.randrange(300), i, rng.choice(["a", "b", None]))
        for i in range(3000)
    ]
    df = spark.createDataFrame(changes, "k int, at int, seq int, v string").repartition(7)
    assert rows(load.scd2_history(df, ["k"], ["v"], "at", "seq")) == brute_history(changes)
    assert load.scd2_history(df.limit(0), ["k"], ["v"], "at", "seq").count() == 0


def test_history_intervals_do_not_overlap(spark):
    changes = [(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 9, 3, "b"), (1, 12, 4, "a")]
    df = spark.createDataFrame(changes, "k int, at int, seq int, v string")
    assert rows(load.scd2_history(df, ["k"], ["v"], "at", "seq")) == [
        (1, "a", 12, None, True),
        (1, "a", 5, 5, False),
        (1, "b", 5, 12, False),
    ]


def test_neighbours_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    ordered = in_order(df, ["k", "v"], "test")
    got = neighbour(ordered, ["k"], {"v": "before"}, previous=True, found="has").orderBy("k", "v").collect()
    assert all(r.before == r.v - 3 if r.has else r.v < 3 for r in got)
    gaps = ordered.filter("v % 2 = 0")
    after = neighbour(gaps, ["k"], {"v": "after"}, previous=False, found="has").collect()
    assert all(r.after == r.v + 6 if r.has else r.v + 6 >= 1000 for r in after)


MERGE = "id int, v string"
CHANGE = "id int, v string, seq int, row_action string"


def test_merge(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], MERGE)
    changes = spark.createDataFrame(
        [
            (1, "x", 1, "update"),
            (1, "y", 2, "update"),
            (2, None, 1, "delete"),
            (3, "z", 1, "insert"),
            (4, "w", 1, "update"),
            (5, "n", 1, "insert"),
            (6, "u", 1, "upsert"),
            (7, "gone", 1, "upsert"),
            (7, "gone", 2, "delete"),
        ],
        CHANGE,
    )
    merged = load.merge_upsert(target, changes, ["id"], "seq")
    expected = [(1, "y"), (3, "c"), (5, "n"), (6, "u"), (None, "n")]
    assert rows(merged) == expected
    assert rows(load.merge_conflicts(target, changes, ["id"], "seq")) == [(3, 1, "insert"), (4, 1, "update")]


def folded_plainly(target, changes):
    """The target after the changes one by one, and those that did nothing."""
    state, idle = dict(target), []
    for key, value, seq, action in sorted(changes, key=lambda c: c[2]):
        there = key in state
        if (action == "insert") == there and action in ("insert", "update", "delete"):
            idle.append((key, seq, action))
        elif action == "delete":
            del state[key]
        else:
            state[key] = value
    return sorted(state.items(), key=repr), sorted(idle, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_is_a_fold_wherever_the_changes_are_cut(spark, seed):
    rng = random.Random(seed)
    target = [(k if k else None, f"t{k}") for k in range(0, 60, 2)]
    changes = []
    for seq in range(600):
        key = 7 if rng.random() < 0.35 else rng.randrange(60)
        changes.append((key if key else None, f"c{seq}", seq, rng.choice(["insert", "update", "upsert", "delete"])))
    want, idle = folded_plainly(target, changes)
    old = spark.createDataFrame(target, MERGE)
    assert rows(load.merge_upsert(old, spark.createDataFrame(changes, CHANGE).repartition(5), ["id"], "seq")) == want
    assert rows(load.merge_conflicts(old, spark.createDataFrame(changes, CHANGE).repartition(5), ["id"], "seq")) == idle
    cuts = sorted(rng.sample(range(1, 600), 3))
    for low, high in zip([0, *cuts], [*cuts, 600]):
        merged = load.merge_upsert(old, spark.createDataFrame(changes[low:high], CHANGE), ["id"], "seq")
        old = spark.createDataFrame(merged.collect(), MERGE)
    assert rows(old) == want


def test_merge_of_changes_that_undo_each_other(spark):
    target = spark.createDataFrame([(2, "old"), (3, "old")], MERGE)
    changes = spark.createDataFrame(
        [(1, "a", 1, "insert"), (1, "b", 2, "update"), (2, None, 1, "delete"), (2, "new", 2, "insert"), (4, "x", 1, "upsert"), (4, None, 2, "delete")],
        CHANGE,
    )
    assert rows(load.merge_upsert(target, changes, ["id"], "seq")) == [(1, "b"), (2, "new"), (3, "old")]
    assert load.merge_conflicts(target, changes, ["id"], "seq").count() == 0


def test_upserts_are_idempotent(spark):
    target = spark.range(50).select(F.col("id").cast("int").alias("id"), F.lit("old").alias("v"))
    changes = spark.range(40, 60).selectExpr("cast(id AS int) AS id", "'new' AS v", "1 AS seq", "'upsert' AS row_action")
    once = load.merge_upsert(target, changes, ["id"], "seq")
    assert rows(load.merge_upsert(once, changes, ["id"], "seq")) == rows(once)
    assert once.count() == 60


def test_replay_of_the_audit_log(spark):
    state = load.changelog_replay(shop.audit_log(spark), ["table_name", "record_id"], "log_id")
    assert rows(state.filter("alive").drop("alive")) == [
        ("customers", "1", "city", "Boston"),
        ("customers", "1", "name", "Acme"),
        ("customers", "3", "name", "New"),
        ("orders", "7", "note", "x"),
        ("orders", "7", "status", None),
    ]


def test_the_dead_stay_dead_and_records_without_fields_are_kept(spark):
    log = [
        (1, 1, "INSERT", '{"a": "1"}'), (2, 1, "DELETE", None), (3, 1, "UPDATE", '{"a": "2"}'),
        (4, 2, "INSERT", "{}"), (5, 3, "DELETE", None), (6, 3, "INSERT", '{"b": "1"}'), (7, 4, "UPDATE", '{"c": "1"}'),
    ]
    df = spark.createDataFrame(log, "log_id int, record int, event_type string, new_values string")
    assert rows(load.changelog_replay(df, ["record"], "log_id")) == [
        (1, False, None, None), (2, True, None, None), (3, True, "b", "1"), (4, True, "c", "1"),
    ]


def test_replay_matches_a_fold_with_a_hot_record(spark):
    rng = random.Random(3)
    log = []
    for i in range(2000):
        record = 0 if rng.random() < 0.35 else rng.randrange(1, 60)
        kind = rng.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "DELETE"])
        log.append((i, record, kind, None if kind == "DELETE" else '{"f%d": "%d"}' % (rng.randrange(4), i)))
    state: dict[int, dict | None] = {}
    for i, record, kind, text in log:
        fields = {} if text is None else {text[2:4]: text.split('"')[3]}
        if kind == "DELETE":
            state[record] = None
        elif kind == "INSERT":
            state[record] = fields
        elif state.get(record, {}) is not None:
            state[record] = {**state.get(record, {}), **fields}
    expected = [(r, True, f, v) for r, fs in state.items() if fs is not None for f, v in (fs or {None: None}).items()]
    expected += [(r, False, None, None) for r, fs in state.items() if fs is None]
    df = spark.createDataFrame(log, "log_id int, record int, event_type string, new_values string")
    assert rows(load.changelog_replay(df, ["record"], "log_id")) == sorted(expected, key=repr)


def test_copies_report_each_table(spark, tmp_path):
    bad = spark.range(3).select(F.expr("id / if(id = 1, raise_error('broken'), 1)").alias("v"))
    status = load.copy_tables({"good": spark.range(5), "bad": bad}, str(tmp_path), parallel=2)
    got = {r.table_name: (r.status, r.row_count) for r in status.collect()}
    assert got == {"good": ("copied", 5), "bad": ("failed", None)}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 5


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 3, "c")], "k int, o int, v string")
    assert len({rows(first_per_key(df.repartition(n), ["k"], ["o"]))[0] for n in (1, 2, 3)}) == 1
