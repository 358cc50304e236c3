from __future__ import annotations

from datetime import datetime

import pytest
from frames import rows
from pyspark.sql import functions as F

from drayage.functions.control_catalogue import DOMAINS, MANUAL_CONTROLS, MANUAL_REASONS
from drayage.operators import controls as c
from drayage.operators import findings as f

SHOWN = ("control_id", "status", "severity", "resource_name", "current_value")


def evaluate(spark, inventory, rules):
    return c.evaluate_controls(spark, inventory, rules, datetime(2024, 1, 1))


def test_empty_tables_and_absent_tables_differ(spark):
    empty = spark.range(0).select(F.lit("").alias("id"), F.lit("").alias("name"))
    got = rows(evaluate(spark, {"log_workspaces": empty, "private_endpoints": empty}, c.EXISTENCE), *SHOWN)
    assert got == [
        ("IR-2", "MANUAL_REVIEW", "High", "Subscription", "Could not read security_contacts"),
        ("LT-5", "FAIL", "High", "Subscription", "No Log Analytics workspace"),
        ("NS-2", "MANUAL_REVIEW", "Medium", "Subscription", "No private endpoints found"),
    ]


def test_storage_accounts(spark):
    path = "/subscriptions/s/resourceGroups/rg1/providers/p/storage"
    accounts = spark.createDataFrame(
        [(path, "a", True, "TLS1_2", True, 7), ("short", "b", None, None, False, None)],
        "id string, name string, enable_https_traffic_only boolean, minimum_tls_version string, "
        "blob_soft_delete_enabled boolean, blob_soft_delete_days int",
    )
    found = evaluate(spark, {"storage_accounts": accounts}, c.PREDICATE)
    assert rows(found, "control_id", "status", "severity", "resource_group", "current_value") == [
        ("BR-2", "FAIL", "Medium", "", "Blob soft delete: Disabled"),
        ("BR-2", "PASS", "Info", "rg1", "Blob soft delete: 7 days"),
        ("DP-3", "FAIL", "High", "", "HTTPS only: Disabled"),
        ("DP-3", "FAIL", "High", "", "Min TLS: TLS1_0"),
        ("DP-3", "PASS", "Info", "rg1", "HTTPS only: Enabled"),
        ("DP-3", "PASS", "Info", "rg1", "Min TLS: TLS1_2"),
        ("DP-4", "PASS", "Info", "", "Encryption: Platform-managed keys"),
        ("DP-4", "PASS", "Info", "rg1", "Encryption: Platform-managed keys"),
    ]
    assert found.columns == [*c.FINDING_COLUMNS, "assessed_at"]


def test_subnets_without_group_are_named(spark):
    networks = spark.createDataFrame(
        [
            ("i", "v1", [("front", None), ("back", "nsg"), ("data", None)]),
            ("i", "v2", [("only", "nsg")]),
            ("i", "v3", None),
        ],
        "id string, name string, subnets array<struct<name: string, security_group: string>>",
    )
    got = rows(evaluate(spark, {"virtual_networks": networks}, c.CHILDREN), "resource_name", "status", "current_value")
    assert got == [
        ("v1", "FAIL", "Subnets without NSG: front, data"),
        ("v2", "PASS", "All subnets have NSG"),
        ("v3", "PASS", "All subnets have NSG"),
    ]


@pytest.mark.parametrize(
    ("score", "status", "severity"), [(70, "PASS", "Info"), (69, "FAIL", "Medium"), (50, "FAIL", "Medium"), (49, "FAIL", "High")]
)
def test_score_grades(spark, score, status, severity):
    scores = spark.createDataFrame([(1, score, 100), (2, 0, 100)], "ordinal int, current_score int, max_score int")
    found = evaluate(spark, {"secure_scores": scores}, c.RATIO).filter("control_id = 'PV-1'")
    assert rows(found, "status", "severity") == [(status, severity)]


def test_no_score_gives_no_row_and_no_policies_comply(spark):
    scores = spark.createDataFrame([], "ordinal int, current_score int, max_score int")
    none = spark.createDataFrame([], "compliant boolean")
    got = rows(evaluate(spark, {"secure_scores": scores, "policy_resources": none}, c.RATIO), "control_id", "status", "current_value")
    assert got == [("AM-2", "PASS", "Policy compliance: 100.0%")]


def test_owner_is_tested_before_contributor(spark):
    assignments = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "role_definition_id int")
    definitions = spark.createDataFrame([(1, "Owner"), (2, "Contributor Owner"), (3, "Contributor")], "id int, role_name string")
    named = c.with_role_names(assignments, definitions)
    assert named.filter("role_name = 'Unknown'").count() == 1
    got = rows(evaluate(spark, {"role_assignments": named}, c.ROLES), "control_id", "status", "current_value")
    assert got == [("PA-1", "PASS", "Owner assignments: 3"), ("PA-7", "MANUAL_REVIEW", "Total role assignments: 5")]


def test_named_plan_is_the_first_of_its_name(spark):
    plans = spark.createDataFrame(
        [("i", "VirtualMachines", "Free", 2), ("i", "VirtualMachines", "Standard", 1), ("i", "Dns", "Free", 0)],
        "id string, name string, pricing_tier string, ordinal int",
    )
    got = rows(evaluate(spark, {"defender_plans": plans}, c.NAMED), "control_id", "status")
    assert got == [("ES-1", "PASS"), ("PV-5", "PASS")]
    graded = evaluate(spark, {"defender_plans": plans}, c.PREDICATE)
    assert rows(graded, "resource_name", "status", "severity") == [
        ("Dns", "FAIL", "Medium"),
        ("VirtualMachines", "FAIL", "High"),
        ("VirtualMachines", "PASS", "Medium"),
    ]


def test_manual_controls(spark):
    found = evaluate(spark, {}, c.ALL).filter("resource_type = 'Organization'")
    assert found.count() == len(MANUAL_CONTROLS) == 56
    assert found.select("status").distinct().collect()[0].status == "MANUAL_REVIEW"
    by_id = {r.control_id: r for r in found.collect()}
    assert by_id["IM-5"].current_value == "Requires Entra ID review"
    assert by_id["GS-11"].expected_value == by_id["GS-11"].recommendation == MANUAL_CONTROLS["GS-11"][1]
    assert {r.current_value for r in by_id.values()} == {value for value, _ in MANUAL_REASONS.values()}


def test_domains_without_findings_are_kept(spark):
    rows_in = [("NS-1", "PASS", "Info"), ("NS-2", "fail", "HIGH"), ("XX-1", "FAIL", "critical"), ("loose", "FAIL", "low")]
    findings = spark.createDataFrame(rows_in, "control_id string, status string, severity string")
    by_domain = f.findings_by_domain(findings).collect()
    assert [r.domain for r in by_domain] == [*DOMAINS, "other"]
    assert (by_domain[0].total, by_domain[0].compliance_percent) == (2, 50.0)
    assert by_domain[-1].total == 2 and by_domain[1].total == 0
    summary = f.findings_summary(findings).first()
    assert (summary.total, summary.failed, summary.failed_critical, summary.failed_high) == (4, 3, 1, 1)
    assert f.findings_summary(findings.limit(0)).first().compliance_percent == 0.0


def test_detail_is_written_by_domain(spark, tmp_path):
    findings = spark.createDataFrame([("NS-1", "a"), ("DP-2", "b"), ("NS-2", "c")], "control_id string, resource_name string")
    f.write_findings_detail(findings, str(tmp_path / "detail"))
    back = spark.read.parquet(str(tmp_path / "detail"))
    assert rows(back, "domain", "control_id") == [("DP", "DP-2"), ("NS", "NS-1"), ("NS", "NS-2")]


def test_policy_states_without_a_verdict_are_not_violations(spark):
    states = spark.createDataFrame(
        [("r", "p1", "Compliant"), ("r", "p2", None), ("s", "p1", "NonCompliant")],
        "resource_id string, policy_name string, compliance_state string",
    )
    assert rows(f.policy_state(states)) == [("r", 2, 0, True), ("s", 1, 1, False)]
    assert rows(f.policy_violations(states)) == [("s", "p1", "NonCompliant")]
