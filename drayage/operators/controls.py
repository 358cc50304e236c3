"""Control checks over resource inventories.

A rule is data: a condition and the outcome of each case, as Spark SQL text.
All row rules of a table run in one scan that emits a finding per row and rule;
all table rules of a table share one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.functions import control_catalogue as cat
from drayage.functions.control_catalogue import FAIL, MANUAL_REVIEW, PASS

FINDING_COLUMNS = (
    "control_id",
    "title",
    "status",
    "severity",
    "resource_name",
    "resource_type",
    "resource_group",
    "current_value",
    "expected_value",
    "finding",
    "recommendation",
    "rationale",
)

SUBSCRIPTION = "Subscription"


@dataclass(frozen=True)
class Outcome:
    """Status, severity and the observed value (SQL text) of one case."""

    status: str
    severity: str
    current: str
    advice: str = "No action required"


@dataclass(frozen=True)
class RowRule:
    """One finding per resource: the first case whose condition holds.

    The table has ``id`` and ``name``.
    """

    control_id: str
    table: str
    resource_type: str
    expected: str
    cases: Sequence[tuple[str, Outcome]]
    grouped: bool = True


@dataclass(frozen=True)
class TableRule:
    """One finding per table: the first case that holds for the measures.

    ``unreadable`` is the severity of the manual-review finding that stands in
    when the inventory lacks the table; None leaves it out.
    """

    control_id: str
    table: str
    expected: str
    measures: Mapping[str, str]
    cases: Sequence[tuple[str, Outcome]]
    unreadable: str | None = None


@dataclass(frozen=True)
class Rules:
    rows: Sequence[RowRule] = ()
    tables: Sequence[TableRule] = ()
    manual: Mapping[str, tuple[str, str]] = field(default_factory=dict)


# The fifth part of the resource path ``id``; empty if the path is shorter.
RESOURCE_GROUP = "coalesce(get(split(id, '/'), 4), '')"


# What a scan emits per finding; everything else depends on the case alone.
HIT_COLUMNS = "case_id int, resource_name string, resource_group string, current_value string"


class _Cases:
    """Numbers the cases of all rules, and holds what is fixed for each."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(
        self, control_id: str, title: str, kind: str, expected: str, outcome: Outcome, rationale: str | None = None
    ) -> int:
        self.rows.append(
            (
                len(self.rows),
                control_id,
                title,
                outcome.status,
                outcome.severity,
                kind,
                expected,
                outcome.advice,
                rationale or f"{control_id} expects: {expected}",
            )
        )
        return len(self.rows) - 1

    def complete(self, hits: DataFrame) -> DataFrame:
        """``hits`` with the fixed columns of their case.

        The joined table has one row per case of the rules, whatever the data.
        """
        schema = (
            "case_id int, control_id string, title string, status string, severity string, resource_type string, "
            "expected_value string, recommendation string, rationale string"
        )
        cases = F.broadcast(hits.sparkSession.createDataFrame(self.rows, schema))
        joined = hits.join(cases, "case_id")
        return joined.withColumn("finding", F.concat("title", F.lit(": "), "current_value")).select(*FINDING_COLUMNS)


def _hit(cases: _Cases, control_id: str, kind: str, expected: str, choices: Sequence[tuple[str, Outcome]]) -> str:
    """SQL for the case that holds first and its observed value, or NULL."""
    title = cat.TITLES.get(control_id, control_id)
    branches = []
    for condition, outcome in choices:
        case_id = cases.add(control_id, title, kind, expected, outcome)
        value = f"named_struct('case_id', {case_id}, 'current_value', cast({outcome.current} AS string))"
        branches.append(f"WHEN {condition} THEN {value}")
    return f"CASE {' '.join(branches)} END"


def _row_hits(cases: _Cases, df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """Hits of all row rules of one table, in one scan."""
    found = [_hit(cases, r.control_id, r.resource_type, r.expected, r.cases) for r in rules]
    grouped = ", ".join(str(r.grouped).lower() for r in rules)
    hits = df.selectExpr("id", "name", f"posexplode(array({', '.join(found)})) AS (_rule, _hit)")
    return hits.filter("_hit IS NOT NULL").selectExpr(
        "_hit.case_id",
        "cast(name AS string) AS resource_name",
        f"if(array({grouped})[_rule], {RESOURCE_GROUP}, '') AS resource_group",
        "_hit.current_value",
    )


def _table_hits(cases: _Cases, df: DataFrame, rules: Sequence[TableRule]) -> DataFrame:
    """Hits of all table rules of one table, from one aggregate.

    Rules may share measures; a measure name must mean the same in all of them.
    """
    measures: dict[str, str] = {}
    for r in rules:
        for name, text in r.measures.items():
            if measures.setdefault(name, text) != text:
                raise ValueError(f"measure {name!r} of {r.table} has two meanings")
    measured = df.agg(*[F.expr(text).alias(name) for name, text in measures.items()])
    found = [_hit(cases, r.control_id, SUBSCRIPTION, r.expected, r.cases) for r in rules]
    hits = measured.selectExpr(f"explode(array({', '.join(found)})) AS _hit").filter("_hit IS NOT NULL")
    return hits.selectExpr(
        "_hit.case_id",
        f"'{SUBSCRIPTION}' AS resource_name",
        "'' AS resource_group",
        "_hit.current_value",
    )


def _fixed_hits(cases: _Cases, unreadable: Sequence[TableRule], manual: Mapping[str, tuple[str, str]]) -> list[tuple]:
    """Hits that need no data: tables that are absent, and manual controls."""
    rows = []
    for r in unreadable:
        outcome = Outcome(MANUAL_REVIEW, r.unreadable, "", "Review manually")
        case_id = cases.add(r.control_id, cat.TITLES.get(r.control_id, r.control_id), SUBSCRIPTION, r.expected, outcome)
        rows.append((case_id, SUBSCRIPTION, "", f"Could not read {r.table}"))
    for control_id, (title, guidance) in manual.items():
        outcome = Outcome(MANUAL_REVIEW, "Medium", "", guidance)
        value, reason = cat.MANUAL_REASONS.get(control_id.split("-")[0], ("Requires review", None))
        case_id = cases.add(control_id, title, "Organization", guidance, outcome, reason)
        rows.append((case_id, "Organization", "", value))
    return rows


def evaluate_controls(
    spark: SparkSession, inventory: Mapping[str, DataFrame], rules: Rules, assessed_at: datetime | None = None
) -> DataFrame:
    """All findings of ``rules`` over the inventory tables.

    Row rules of an absent table give nothing; table rules give a manual-review
    finding. ``assessed_at`` is the time of the run if not given.
    """
    cases = _Cases()
    parts: list[DataFrame] = []
    unreadable: list[TableRule] = []
    for table in dict.fromkeys(r.table for r in rules.rows):
        if table in inventory:
            parts.append(_row_hits(cases, inventory[table], [r for r in rules.rows if r.table == table]))
    for table in dict.fromkeys(r.table for r in rules.tables):
        wanted = [r for r in rules.tables if r.table == table]
        if table in inventory:
            parts.append(_table_hits(cases, inventory[table], wanted))
        else:
            unreadable += [r for r in wanted if r.unreadable]
    fixed = _fixed_hits(cases, unreadable, rules.manual)
    if fixed:
        parts.append(spark.createDataFrame(fixed, HIT_COLUMNS))
    if not parts:
        raise ValueError("no rule applies to the inventory")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    stamp = F.lit(assessed_at) if assessed_at is not None else F.current_timestamp()
    return cases.complete(hits).withColumn("assessed_at", stamp.cast("timestamp"))


def with_role_names(assignments: DataFrame, definitions: DataFrame) -> DataFrame:
    """Add ``role_name`` by ``role_definition_id``; "Unknown" without a match.

    Definitions have one row per id. Spark broadcasts them when small.
    """
    names = definitions.select(F.col("id").alias("role_definition_id"), F.col("role_name").alias("_name"))
    joined = assignments.join(names, "role_definition_id", "left")
    return joined.withColumn("role_name", F.coalesce("_name", F.lit("Unknown"))).drop("_name")


def child_findings(
    resources: DataFrame,
    children: DataFrame,
    key: str,
    failing: Column | str,
    control_id: str,
    resource_type: str,
    expected: str,
    severity: str = "Medium",
) -> DataFrame:
    """Findings on a flat child table: how many children of each resource fail.

    Children are counted before the join, so that a resource with a third of
    all children is one row there. :func:`failing_children` names them.
    """
    test = F.expr(failing) if isinstance(failing, str) else failing
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias("_all"), F.count_if(test).alias("_bad"))
    joined = resources.join(counted, key, "left").fillna(0, ["_all", "_bad"])
    value = "concat(_bad, ' of ', _all, ' children fail')"
    rule = RowRule(
        control_id,
        "",
        resource_type,
        expected,
        [("_bad > 0", Outcome(FAIL, severity, value, "Fix the failing children")), ("true", Outcome(PASS, "Info", value))],
    )
    cases = _Cases()
    return cases.complete(_row_hits(cases, joined, [rule]))


def failing_children(children: DataFrame, key: str, name: str, failing: Column | str) -> DataFrame:
    """One row per failing child: its resource and its name."""
    test = F.expr(failing) if isinstance(failing, str) else failing
    return children.filter(test).select(F.col(key).alias("resource_key"), F.col(name).alias("child_name"))


# The checks, by shape. Conditions and values are Spark SQL over the inventory.

_STORAGE = "Microsoft.Storage/storageAccounts"
_VAULT = "Microsoft.KeyVault/vaults"
_NSG = "Microsoft.Network/networkSecurityGroups"
_VM = "Microsoft.Compute/virtualMachines"
_RECOVERY = "Microsoft.RecoveryServices/vaults"
_COUNT = {"n": "count(*)"}
_TLS = f"coalesce(minimum_tls_version, '{cat.OLDEST_TLS}')"


def _flag(condition: str, name: str, severity: str, advice: str, status: str = FAIL) -> list[tuple[str, Outcome]]:
    """Enabled passes, disabled or unknown fails."""
    return [
        (condition, Outcome(PASS, "Info", f"'{name}: Enabled'")),
        ("true", Outcome(status, severity, f"'{name}: Disabled'", advice)),
    ]


EXISTENCE = Rules(
    rows=[
        RowRule(
            "NS-3",
            "firewalls",
            "Microsoft.Network/azureFirewalls",
            "Firewall should be deployed",
            [("true", Outcome(PASS, "Info", "concat('Provisioning state: ', coalesce(provisioning_state, 'None'))"))],
        ),
        RowRule(
            "BR-1",
            "recovery_vaults",
            _RECOVERY,
            "Recovery Services vault should exist",
            [("true", Outcome(PASS, "Info", "concat('Vault location: ', coalesce(location, 'None'))"))],
        ),
    ],
    tables=[
        TableRule(
            "NS-2",
            "private_endpoints",
            "Use private endpoints for PaaS services",
            _COUNT,
            [
                ("n = 0", Outcome(MANUAL_REVIEW, "Medium", "'No private endpoints found'", "Add private endpoints")),
                ("true", Outcome(PASS, "Info", "concat(n, ' private endpoints found')")),
            ],
        ),
        TableRule(
            "NS-3",
            "firewalls",
            "Firewall should be deployed",
            _COUNT,
            [("n = 0", Outcome(FAIL, "High", "'No Azure Firewall found'", "Deploy a firewall"))],
        ),
        TableRule(
            "NS-4",
            "ddos_plans",
            "DDoS Protection should be enabled",
            _COUNT,
            [
                ("n = 0", Outcome(FAIL, "High", "'No DDoS Protection Plan found'", "Enable DDoS protection")),
                ("true", Outcome(PASS, "Info", "concat(n, ' DDoS Protection Plan(s) found')")),
            ],
        ),
        TableRule(
            "NS-10",
            "private_dns_zones",
            "Use Azure DNS or secure DNS configuration",
            _COUNT,
            [
                ("n = 0", Outcome(MANUAL_REVIEW, "Low", "concat(n, ' Private DNS zones found')", "Review DNS")),
                ("true", Outcome(PASS, "Low", "concat(n, ' Private DNS zones found')")),
            ],
        ),
        TableRule(
            "LT-5",
            "log_workspaces",
            "Log Analytics workspace should exist",
            _COUNT,
            [
                ("n = 0", Outcome(FAIL, "High", "'No Log Analytics workspace'", "Create a workspace")),
                ("true", Outcome(PASS, "Info", "concat(n, ' Log Analytics workspace(s)')")),
            ],
            unreadable="High",
        ),
        TableRule(
            "IR-2",
            "security_contacts",
            "Security contacts should be configured",
            _COUNT,
            [
                ("n = 0", Outcome(FAIL, "High", "'No security contacts configured'", "Configure contacts")),
                ("true", Outcome(PASS, "Info", "concat(n, ' security contact(s) configured')")),
            ],
            unreadable="High",
        ),
        TableRule(
            "BR-1",
            "recovery_vaults",
            "Recovery Services vault should exist",
            _COUNT,
            [("n = 0", Outcome(FAIL, "High", "'No Recovery Services vaults'", "Create a vault"))],
        ),
    ],
)

PREDICATE = Rules(
    rows=[
        RowRule(
            "DP-3",
            "storage_accounts",
            _STORAGE,
            "HTTPS traffic only should be enabled",
            _flag("enable_https_traffic_only", "HTTPS only", "High", "Require secure transfer"),
        ),
        RowRule(
            "DP-3",
            "storage_accounts",
            _STORAGE,
            "TLS 1.2 or higher required",
            [
                (
                    f"{_TLS} IN {cat.MODERN_TLS}",
                    Outcome(PASS, "Info", f"concat('Min TLS: ', {_TLS})"),
                ),
                ("true", Outcome(FAIL, "High", f"concat('Min TLS: ', {_TLS})", "Set the minimum TLS version to 1.2")),
            ],
        ),
        RowRule(
            "DP-4",
            "storage_accounts",
            _STORAGE,
            "Data at rest should be encrypted",
            [("true", Outcome(PASS, "Info", "'Encryption: Platform-managed keys'"))],
        ),
        RowRule(
            "BR-2",
            "storage_accounts",
            _STORAGE,
            "Enable blob soft delete",
            [
                (
                    "blob_soft_delete_enabled",
                    Outcome(PASS, "Info", "concat('Blob soft delete: ', blob_soft_delete_days, ' days')"),
                ),
                ("true", Outcome(FAIL, "Medium", "'Blob soft delete: Disabled'", "Enable blob soft delete")),
            ],
        ),
        RowRule(
            "BR-2",
            "recovery_vaults",
            _RECOVERY,
            "Soft delete should be enabled",
            [("true", Outcome(PASS, "Info", "'Soft delete: Enabled by default'"))],
        ),
        RowRule(
            "DP-8",
            "key_vaults",
            _VAULT,
            "Soft delete should be enabled",
            _flag("enable_soft_delete", "Soft delete", "High", "Enable soft delete"),
        ),
        RowRule(
            "DP-8",
            "key_vaults",
            _VAULT,
            "Purge protection should be enabled",
            _flag("enable_purge_protection", "Purge protection", "Medium", "Enable purge protection"),
        ),
        RowRule(
            "IM-3",
            "virtual_machines",
            _VM,
            "Use managed identity",
            [
                ("identity_type IS NOT NULL", Outcome(PASS, "Info", "concat('Identity type: ', identity_type)")),
                ("true", Outcome(FAIL, "Medium", "'No managed identity'", "Enable a managed identity")),
            ],
        ),
        RowRule(
            "IM-4",
            "web_apps",
            "Microsoft.Web/sites",
            "Use managed identity for Azure service auth",
            [
                ("identity_type IS NOT NULL", Outcome(PASS, "Info", "'Managed identity enabled'")),
                ("true", Outcome(FAIL, "Medium", "'No managed identity'", "Enable a managed identity")),
            ],
        ),
        RowRule(
            "NS-5",
            "security_groups",
            _NSG,
            "Security rules should be defined",
            [
                (
                    "coalesce(rule_count, 0) = 0",
                    Outcome(MANUAL_REVIEW, "Low", "'No custom rules defined'", "Review whether rules are needed"),
                ),
                ("true", Outcome(PASS, "Info", "concat(rule_count, ' custom rules defined')")),
            ],
        ),
        RowRule(
            "LT-4",
            "security_groups",
            _NSG,
            "Enable NSG flow logs",
            [("true", Outcome(MANUAL_REVIEW, "Medium", "'Flow log status requires Network Watcher check'", "Check flow logs"))],
        ),
        RowRule(
            "LT-1",
            "defender_plans",
            "Microsoft.Security/pricings",
            "Standard tier recommended",
            [
                ("pricing_tier = 'Standard'", Outcome(PASS, "Medium", "concat('Tier: ', pricing_tier)")),
                (
                    f"name IN {cat.KEY_DEFENDER_PLANS}",
                    Outcome(FAIL, "High", "concat('Tier: ', coalesce(pricing_tier, 'None'))", "Enable the Standard tier"),
                ),
                (
                    "true",
                    Outcome(FAIL, "Medium", "concat('Tier: ', coalesce(pricing_tier, 'None'))", "Enable the Standard tier"),
                ),
            ],
            grouped=False,
        ),
    ]
)

_OPEN_SUBNETS = (
    "array_join(transform(filter(coalesce(subnets, array()), s -> s.security_group IS NULL), s -> s.name), ', ')"
)

CHILDREN = Rules(
    rows=[
        RowRule(
            "NS-1",
            "virtual_networks",
            "Microsoft.Network/virtualNetworks",
            "All subnets should have NSG attached",
            [
                (
                    "exists(subnets, s -> s.security_group IS NULL)",
                    Outcome(FAIL, "Medium", f"concat('Subnets without NSG: ', {_OPEN_SUBNETS})", "Attach NSGs"),
                ),
                ("true", Outcome(PASS, "Info", "'All subnets have NSG'")),
            ],
        )
    ],
    tables=[
        TableRule(
            "NS-1",
            "virtual_networks",
            "At least one VNet should exist",
            _COUNT,
            [("n = 0", Outcome(FAIL, "High", "'No VNets found'", "Create virtual networks"))],
        )
    ],
)

_COMPLIANCE = "if(total > 0, 100D * (total - non_compliant) / total, 100D)"
_SCORE = "if(max_score > 0, 100D * current_score / max_score, 0D)"
_TAGGED = "if(total > 0, 100D * tagged / total, 0D)"


def _percent(value: str) -> str:
    return f"concat(cast(cast({value} AS decimal(10,1)) AS string), '%')"


RATIO = Rules(
    tables=[
        TableRule(
            "AM-1",
            "resources",
            "Maintain complete asset inventory",
            {"total": "count(*)", "tagged": "count_if(size(tags) > 0)"},
            [
                (
                    condition,
                    Outcome(
                        status,
                        "Info",
                        f"concat('Resources: ', total, ', Tagged: ', tagged, ' (', {_percent(_TAGGED)}, ')')",
                        "Tag all resources",
                    ),
                )
                for condition, status in (("total > 0", PASS), ("true", FAIL))
            ],
        ),
        TableRule(
            "AM-2",
            "policy_resources",
            "Azure Policy compliance should be 90%+",
            {"total": "count(*)", "non_compliant": "count_if(NOT compliant)"},
            [
                (condition, Outcome(status, severity, f"concat('Policy compliance: ', {_percent(_COMPLIANCE)})", advice))
                for condition, status, severity, advice in (
                    (f"{_COMPLIANCE} >= {cat.MIN_POLICY_COMPLIANCE}", PASS, "Info", "No action required"),
                    ("true", FAIL, "Medium", "Remediate non-compliant resources"),
                )
            ],
            unreadable="Medium",
        ),
        TableRule(
            "PV-1",
            "secure_scores",
            "Secure Score should be 70%+",
            {
                "n": "count(*)",
                "current_score": "min_by(current_score, ordinal)",
                "max_score": "min_by(max_score, ordinal)",
            },
            [
                (condition, Outcome(status, severity, f"concat('Secure Score: ', {_percent(_SCORE)})", advice))
                for condition, status, severity, advice in (
                    (f"n > 0 AND {_SCORE} >= {cat.MIN_SECURE_SCORE}", PASS, "Info", "No action required"),
                    (f"n > 0 AND {_SCORE} >= {cat.LOW_SECURE_SCORE}", FAIL, "Medium", "Address the recommendations"),
                    ("n > 0", FAIL, "High", "Address the recommendations"),
                )
            ],
            unreadable="High",
        ),
    ]
)

_ROLE_MEASURES = {
    "owners": "count_if(contains(role_name, 'Owner'))",
    "contributors": "count_if(contains(role_name, 'Contributor') AND NOT contains(role_name, 'Owner'))",
    "total": "count(*)",
}

ROLES = Rules(
    tables=[
        TableRule(
            "PA-1",
            "role_assignments",
            "Limit Owner role to 3 or fewer",
            _ROLE_MEASURES,
            [
                (
                    f"owners > {cat.MAX_OWNERS}",
                    Outcome(FAIL, "High", "concat('Owner assignments: ', owners)", "Reduce Owner assignments"),
                ),
                ("true", Outcome(PASS, "Info", "concat('Owner assignments: ', owners)")),
            ],
        ),
        TableRule(
            "PA-7",
            "role_assignments",
            "Review role assignments for least privilege",
            _ROLE_MEASURES,
            [
                (
                    "true",
                    Outcome(
                        MANUAL_REVIEW, "Medium", "concat('Total role assignments: ', total)", "Audit role assignments"
                    ),
                )
            ],
        ),
    ]
)

_SERVER_PLAN = {"standard": "min_by(pricing_tier, ordinal) FILTER (WHERE name = 'VirtualMachines') = 'Standard'"}

NAMED = Rules(
    rows=[
        RowRule(
            "ES-2",
            "virtual_machines",
            _VM,
            "Anti-malware should be installed",
            [
                (
                    "extensions IS NULL",
                    Outcome(MANUAL_REVIEW, "High", "'Could not check extensions'", "Check the machine"),
                ),
                (
                    f"exists(extensions, e -> lower(e) RLIKE '{cat.ANTIMALWARE_NAMES}')",
                    Outcome(PASS, "Info", "'Anti-malware extension found'"),
                ),
                ("true", Outcome(FAIL, "High", "'No anti-malware extension found'", "Install anti-malware")),
            ],
        )
    ],
    tables=[
        TableRule(
            "PV-5",
            "defender_plans",
            "Enable vulnerability assessment",
            _SERVER_PLAN,
            [
                ("standard", Outcome(PASS, "Info", "'Defender for Servers: Standard'")),
                ("true", Outcome(FAIL, "High", "'Defender for Servers: Not enabled'", "Enable Defender for Servers")),
            ],
        ),
        TableRule(
            "ES-1",
            "defender_plans",
            "Enable EDR capabilities",
            _SERVER_PLAN,
            [
                ("standard", Outcome(PASS, "Info", "'Defender for Servers: Standard'")),
                ("true", Outcome(FAIL, "High", "'Defender for Servers: Not Standard'", "Enable Defender for Servers")),
            ],
        ),
    ],
)

ALL = Rules(
    rows=[r for g in (EXISTENCE, PREDICATE, CHILDREN, RATIO, ROLES, NAMED) for r in g.rows],
    tables=[r for g in (EXISTENCE, PREDICATE, CHILDREN, RATIO, ROLES, NAMED) for r in g.tables],
    manual=cat.MANUAL_CONTROLS,
)
