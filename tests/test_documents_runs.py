from __future__ import annotations

import random

from frames import plan, rows
from pyspark.sql import types as T

from drayage.operators import documents as d
from drayage.operators import runs as r
from drayage.sources.documents import find

DOCS = [
    (1, '{"name": "a", "size": {"w": 1.5, "h": 2}, "tags": ["x", "y"], "_id": 1}'),
    (2, '{"name": null, "size": {"w": 3}, "n": 5}'),
    (3, '{"name": 7, "tags": [], "ok": true}'),
    (4, "no json"),
    (5, "[1, 2]"),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "id int, doc string")


def test_inferred_schema(spark):
    got = rows(d.infer_document_schema(docs(spark), "doc", "id"))
    assert got == [
        ("_id", "int", False, "1"),
        ("n", "int", False, "5"),
        ("name", "NoneType,int,str", True, "a"),
        ("ok", "bool", False, "true"),
        ("size", "dict", False, '{"h":2,"w":1.5}'),
        ("tags", "list", False, '["x","y"]'),
    ]
    sampled = d.infer_document_schema(docs(spark), "doc", "id", sample_docs=1, skip_prefix="_", with_sample=False)
    assert rows(sampled, "field") == [("name",), ("size",), ("tags",)]


def test_drift(spark):
    got = {x.field: (x.document_count, x.type_count, x.drifts) for x in d.schema_drift(docs(spark).filter("id < 4"), "doc", "id").collect()}
    assert got["name"] == (3, 2, True) and got["size"] == (2, 1, True)


def test_common_fields_limits(spark):
    three = docs(spark).filter("id < 4")
    assert rows(d.common_fields(three, "doc", "id"), "field") == [("name",), ("size",), ("tags",)]
    assert d.common_fields(three, "doc", "id", max_complex=1).isEmpty()
    assert d.common_fields(three, "doc", "id", share=1.0).isEmpty()  # one field is no table
    assert d.common_fields(three.filter("id = 1"), "doc", "id").isEmpty()


def test_flatten(spark):
    schema = "name string, size struct<w: double, h: int>, tags array<string>, parts array<struct<p: int, subs: array<int>>>"
    one = spark.createDataFrame([(1, '{"name": "a", "size": {"w": 1.5}, "tags": ["x"], "parts": [{"p": 1, "subs": [7, 8]}, {"p": 2}]}')], "id int, doc string")
    tables = d.flatten_documents(one, ["id"], "doc", schema)
    assert rows(tables["root"]) == [(1, "a", 1.5, None)]
    assert rows(tables["root_tags"]) == [(1, 0, "x")]
    assert rows(tables["root_parts"]) == [(1, 0, 1), (1, 1, 2)]
    assert rows(tables["root_parts_subs"]) == [(1, 0, 0, 7), (1, 0, 1, 8)]


def found(spark, spec):
    return [x.id for x in find(docs(spark), "doc", spec).orderBy("id").collect()]


def test_find(spark):
    assert found(spark, {}) == [1, 2, 3, 5]
    assert found(spark, {"name": "a"}) == [1]
    assert found(spark, {"name": 7}) == [3]
    assert found(spark, {"name": "7"}) == []
    assert found(spark, {"name": None}) == [2, 5]
    assert found(spark, {"name": {"$exists": True}}) == [1, 2, 3]
    assert found(spark, {"size.w": {"$gt": 1.5}}) == [2]
    assert found(spark, {"size.w": {"$gte": 1, "$lt": 2}}) == [1]
    assert found(spark, {"size.w": 1}) == []
    assert found(spark, {"tags.0": "x"}) == [1]
    assert found(spark, {"ok": True}) == [3]
    assert found(spark, {"n": {"$ne": 5}}) == [1, 3, 5]
    assert found(spark, {"$or": [{"n": {"$in": [4, 5]}}, {"ok": True}]}) == [2, 3]
    assert found(spark, {"$nor": [{"n": 5}], "name": {"$not": {"$exists": False}}}) == [1, 3]
    assert found(spark, {"name": {"$nin": ["a", 7]}}) == [2, 5]


def gate(steps):
    """The gate as a loop in step order."""
    status = {n: "pending" for n, _, _ in steps}
    for n, own, needs in sorted(steps):
        status[n] = "skipped" if any(x in status and status[x] != "completed" for x in needs) else own
    return status


def test_gate_matches_a_loop(spark):
    rng = random.Random(11)
    data, expected = [], []
    for p in range(30):
        steps = []
        for n in range(1, 13):
            needs = [rng.randrange(0, 15) for _ in range(rng.randrange(3))]
            steps.append((n, rng.choice(["completed"] * 6 + ["failed"]), needs))
        data += [(p, *s) for s in steps]
        expected += [(p, n, s) for n, s in gate(steps).items()]
    df = spark.createDataFrame(data, "plan_id int, step_number int, status string, dependencies array<int>")
    for folded in (4096, 5):  # in one fold, and link by link
        assert rows(r.dependency_gate(df, folded), "plan_id", "step_number", "gated_status") == sorted(expected, key=repr)


def test_gate_folds_plans_without_a_number_or_dependencies(spark):
    data = [(None, 1, "failed", None), (None, 2, "completed", [1, 9]), (1, 1, None, []), (1, 2, "completed", [1]), (1, 2, "failed", None), (1, 3, "completed", [2])]
    df = spark.createDataFrame(data, "plan_id int, step_number int, status string, dependencies array<int>")
    want = [(None, 1, "failed"), (None, 2, "skipped"), (1, 1, None), (1, 2, "completed"), (1, 2, "failed"), (1, 3, "skipped")]
    assert rows(r.dependency_gate(df), "plan_id", "step_number", "gated_status") == sorted(want, key=repr)


def test_gate_on_a_long_chain(spark):
    data = [(1, n, "failed" if n == 1 else "completed", [n - 1]) for n in range(1, 15)]
    df = spark.createDataFrame(data, "plan_id int, step_number int, status string, dependencies array<int>")
    assert r.dependency_gate(df).filter("gated_status = 'skipped'").count() == 13


def test_progress_and_outcome(spark):
    plans = spark.createDataFrame(
        [(1, [("completed",), ("skipped",), ("failed",), ("pending",)]), (2, []), (3, None)],
        "plan_id int, steps array<struct<status: string>>",
    )
    assert rows(r.run_progress(plans)) == [(1, 4, 2, 1, 0.5), (2, 0, 0, 0, 0.0), (3, 0, 0, 0, 0.0)]
    steps = spark.createDataFrame([(1, "completed"), (1, "skipped"), (2, "failed")], "plan_id int, status string")
    assert rows(r.plan_outcome(steps)) == [(1, "completed"), (2, "failed")]


def test_run_summary_lines(spark):
    steps = spark.createDataFrame(
        [(1, 1, "A", "completed", "x" * 201), (1, 2, "B", "failed", None)],
        "plan_id int, step_number int, agent string, status string, output string",
    )
    got = rows(r.run_summary(steps))
    assert got[0][2] == "Migration plan completed: 1/2 steps successful."
    assert got[1][2] == f"**A**: {'x' * 200}..." and len(got) == 2


def test_plans_of_one_user_are_newest_first(spark):
    plans = spark.createDataFrame([(1, "u", 1), (2, "u", 3), (3, "v", 2)], "plan_id int, user_id string, created_at int")
    assert [p.plan_id for p in r.plans_by_user(plans, "u").collect()] == [2, 1]
    assert [p.plan_id for p in r.plans_by_user(plans).collect()] == [2, 1, 3]


def test_param_filter_short_names(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "t")], "id int, user_id string, team string")
    assert rows(r.param_filter(df, {"@uid": "a", "tid": 2}), "id") == [(2,)]
    assert rows(r.param_filter(df, {"team": None}), "id") == [(1,)]


def test_token_rollup_aggregates_steps_once(spark):
    subtasks = spark.range(10).selectExpr("id % 2 AS plan_id", "id % 4 AS step_number", "id AS prompt_tokens",
                                          "id AS completion_tokens", "2 * id AS total_tokens", "1L AS llm_calls")
    out = r.token_rollup(subtasks)
    assert rows(out.filter("level = 'plan'"), "plan_id", "step_number", "total_tokens") == [(0, None, 40), (1, None, 50)]
    assert "CartesianProduct" not in plan(out)


def test_flatten_without_a_schema(spark):
    docs = [
        (1, '{"a b": 1, "x": {"k": null, "deep": {"z": 1.5}}, "m": {"p": [1], "q": [2, 3]}, "g": [[{"u": 1}], [{"u": "t"}, {}]], "e": {}}'),
        (2, '{"a b": 2, "g": [], "f": []}'),
        (3, None),
        (4, "no json"),
        (5, "[1, 2]"),
    ]
    df = spark.createDataFrame(docs, "id int, doc string")
    got = d.flatten_documents(df, ["id"], "doc", maps=["m"])
    assert sorted(got) == ["root", "root_f", "root_g", "root_g_item", "root_m", "root_m_item"]
    assert got["root"].columns == ["id", "a b", "x_deep_z", "x_k"]
    assert [(x["id"], x["a b"], x["x_deep_z"] and float(x["x_deep_z"])) for x in got["root"].orderBy("id").collect()][:2] == [(1, 1, 1.5), (2, 2, None)]
    assert rows(got["root_m"], "id", "m_key") == [(1, "p"), (1, "q")]
    assert rows(got["root_m_item"], "id", "m_key", "item_pos", "value") == [(1, "p", 0, 1), (1, "q", 0, 2), (1, "q", 1, 3)]
    assert rows(got["root_g_item"], "g_pos", "item_pos", "u") == [(0, 0, "1"), (1, 0, "t"), (1, 1, None)]
    assert got["root_f"].count() == 0
    wide = spark.createDataFrame([(1, '{"w": {' + ", ".join(f'"k{i}": {i}' for i in range(8)) + "}}")], "id int, doc string")
    assert isinstance(d.inferred_schema(wide, "doc", map_fields=7)["w"].dataType, T.MapType)
    assert d.flatten_documents(df.limit(0), ["id"], "doc")["root"].columns == ["id"]
