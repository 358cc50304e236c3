"""Control checks over inventories read from the given tables, and roll-ups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.functions.control_catalogue import MANUAL_CONTROLS
from drayage.operators import controls as c
from drayage.operators import findings as f
from drayage.plans.registry import Tables, query

SHOWN = ["control_id", "status", "severity", "resource_name", "resource_type", "resource_group", "current_value"]
AS_OF = datetime(2024, 1, 1)


def resource_id(key: str) -> str:
    return f"concat('/subscriptions/s/resourceGroups/rg', {key} % 7, '/providers/x/', {key}) AS id"


def inventories(t: Tables) -> dict[str, DataFrame]:
    """Resources named after suppliers, customers, parts and orders.

    There is no ``log_workspaces`` table, and ``ddos_plans`` and
    ``security_contacts`` are empty.
    """
    suppliers, customers, parts = t.supplier, t.spread("customer"), t.spread("part")
    return {
        "private_endpoints": suppliers,
        "firewalls": suppliers.selectExpr(
            resource_id("s_suppkey"), "s_name AS name", "if(s_suppkey % 2 = 0, 'Succeeded', NULL) AS provisioning_state"
        ),
        "ddos_plans": suppliers.filter("s_acctbal > 1000000"),
        "private_dns_zones": parts,
        "security_contacts": customers.filter("c_acctbal > 1000000"),
        "recovery_vaults": suppliers.selectExpr(
            resource_id("s_suppkey"), "s_name AS name", "concat('region', s_nationkey) AS location"
        ),
        "storage_accounts": suppliers.selectExpr(
            resource_id("s_suppkey"),
            "s_name AS name",
            "s_suppkey % 3 <> 0 AS enable_https_traffic_only",
            "CASE s_suppkey % 4 WHEN 1 THEN 'TLS1_0' WHEN 2 THEN 'TLS1_2' WHEN 3 THEN 'TLS1_3' END AS minimum_tls_version",
            "if(s_suppkey % 5 = 0, NULL, s_suppkey % 2 = 0) AS blob_soft_delete_enabled",
            "s_suppkey % 30 AS blob_soft_delete_days",
        ),
        "key_vaults": customers.selectExpr(
            resource_id("c_custkey"),
            "c_name AS name",
            "c_custkey % 3 <> 0 AS enable_soft_delete",
            "c_custkey % 2 = 0 AS enable_purge_protection",
        ),
        "virtual_machines": customers.selectExpr(
            resource_id("c_custkey"),
            "c_name AS name",
            "if(c_custkey % 4 = 0, NULL, 'SystemAssigned') AS identity_type",
            "if(c_custkey % 6 = 0, NULL, array(lower(c_mktsegment), "
            "if(c_custkey % 5 = 0, 'IaaSAntimalware', concat('Ext', c_custkey % 5)))) AS extensions",
        ),
        "security_groups": parts.selectExpr(
            resource_id("p_partkey"), "p_name AS name", "if(p_size % 3 = 0, NULL, p_size % 3) AS rule_count"
        ),
        "defender_plans": parts.selectExpr(
            resource_id("p_partkey"),
            "element_at(array('VirtualMachines', 'SqlServers', 'StorageAccounts', 'Dns'), cast(p_partkey % 4 + 1 AS int)) AS name",
            "if(p_size % 2 = 0, 'Standard', 'Free') AS pricing_tier",
            "p_partkey AS ordinal",
        ),
        "virtual_networks": t.spread("orders").selectExpr(
            resource_id("o_orderkey"),
            "concat('vnet', o_orderkey) AS name",
            "if(o_orderkey % 10 = 0, NULL, array("
            "named_struct('name', concat('a', o_custkey % 10), 'security_group', nullif(o_orderstatus, 'O')), "
            "named_struct('name', concat('b', o_custkey % 10), 'security_group', nullif(o_orderpriority, '5-LOW'))"
            ")) AS subnets",
        ),
        "resources": parts.selectExpr("p_partkey", "if(p_partkey % 3 = 0, map(), map('brand', p_brand)) AS tags"),
        "policy_resources": customers.selectExpr("c_custkey % 8 <> 0 AS compliant"),
        "secure_scores": t.nation.selectExpr(
            "n_nationkey AS ordinal", "55 + n_nationkey AS current_score", "100 AS max_score"
        ),
        "role_assignments": c.with_role_names(
            t.orders.selectExpr("o_orderkey", "o_custkey % 30 AS role_definition_id"),
            t.nation.selectExpr(
                "n_nationkey AS id",
                "CASE n_nationkey % 4 WHEN 0 THEN 'Owner' WHEN 1 THEN 'Contributor' "
                "WHEN 2 THEN 'Owner Contributor' ELSE 'Reader' END AS role_name",
            ),
        ),
    }


def evaluate(t: Tables, rules: c.Rules) -> DataFrame:
    return c.evaluate_controls(t.spark, inventories(t), rules, AS_OF).select(*SHOWN)


def subscription(control: str, status: str, severity: str, value: str, source: str = "") -> str:
    return (
        f"SELECT '{control}' AS control_id, '{status}' AS status, '{severity}' AS severity, "
        "'Subscription' AS resource_name, 'Subscription' AS resource_type, '' AS resource_group, "
        f"{value} AS current_value {source}"
    )


def resource(control: str, status: str, severity: str, kind: str, value: str, key: str, name: str, source: str) -> str:
    return (
        f"SELECT '{control}' AS control_id, {status} AS status, {severity} AS severity, {name} AS resource_name, "
        f"'{kind}' AS resource_type, 'rg' || {key} % 7 AS resource_group, {value} AS current_value FROM {source}"
    )


def either(condition: str, yes: str, no: str) -> str:
    return f"CASE WHEN {condition} THEN '{yes}' ELSE '{no}' END"


EXISTENCE_SQL = " UNION ALL ".join(
    [
        resource(
            "NS-3",
            "'PASS'",
            "'Info'",
            "Microsoft.Network/azureFirewalls",
            "'Provisioning state: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Succeeded' ELSE 'None' END",
            "s_suppkey",
            "s_name",
            "supplier",
        ),
        resource(
            "BR-1",
            "'PASS'",
            "'Info'",
            "Microsoft.RecoveryServices/vaults",
            "'Vault location: region' || s_nationkey",
            "s_suppkey",
            "s_name",
            "supplier",
        ),
        subscription(
            "NS-2", "PASS", "Info", "count(*) || ' private endpoints found'", "FROM supplier"
        ),
        subscription("NS-4", "FAIL", "High", "'No DDoS Protection Plan found'"),
        subscription("NS-10", "PASS", "Low", "count(*) || ' Private DNS zones found'", "FROM part"),
        subscription("LT-5", "MANUAL_REVIEW", "High", "'Could not read log_workspaces'"),
        subscription("IR-2", "FAIL", "High", "'No security contacts configured'"),
    ]
)


@query("control_existence", EXISTENCE_SQL)
def control_existence(t: Tables) -> DataFrame:
    return evaluate(t, c.EXISTENCE)


_SA = "Microsoft.Storage/storageAccounts"
_TLS = "CASE s_suppkey % 4 WHEN 1 THEN 'TLS1_0' WHEN 2 THEN 'TLS1_2' WHEN 3 THEN 'TLS1_3' ELSE 'TLS1_0' END"
_SOFT = "(s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0)"
_NSG = "Microsoft.Network/networkSecurityGroups"
_PLAN = "['VirtualMachines', 'SqlServers', 'StorageAccounts', 'Dns'][(p_partkey % 4 + 1)::INTEGER]"
_KV = "Microsoft.KeyVault/vaults"

PREDICATE_SQL = " UNION ALL ".join(
    [
        resource("DP-3", either("s_suppkey % 3 <> 0", "PASS", "FAIL"), either("s_suppkey % 3 <> 0", "Info", "High"), _SA,
                 either("s_suppkey % 3 <> 0", "HTTPS only: Enabled", "HTTPS only: Disabled"), "s_suppkey", "s_name", "supplier"),
        resource("DP-3", either("s_suppkey % 4 > 1", "PASS", "FAIL"), either("s_suppkey % 4 > 1", "Info", "High"), _SA,
                 f"'Min TLS: ' || {_TLS}", "s_suppkey", "s_name", "supplier"),
        resource("DP-4", "'PASS'", "'Info'", _SA, "'Encryption: Platform-managed keys'", "s_suppkey", "s_name", "supplier"),
        resource("BR-2", either(_SOFT, "PASS", "FAIL"), either(_SOFT, "Info", "Medium"), _SA,
                 f"CASE WHEN {_SOFT} THEN 'Blob soft delete: ' || s_suppkey % 30 || ' days' ELSE 'Blob soft delete: Disabled' END",
                 "s_suppkey", "s_name", "supplier"),
        resource("BR-2", "'PASS'", "'Info'", "Microsoft.RecoveryServices/vaults", "'Soft delete: Enabled by default'",
                 "s_suppkey", "s_name", "supplier"),
        resource("DP-8", either("c_custkey % 3 <> 0", "PASS", "FAIL"), either("c_custkey % 3 <> 0", "Info", "High"), _KV,
                 either("c_custkey % 3 <> 0", "Soft delete: Enabled", "Soft delete: Disabled"), "c_custkey", "c_name", "customer"),
        resource("DP-8", either("c_custkey % 2 = 0", "PASS", "FAIL"), either("c_custkey % 2 = 0", "Info", "Medium"), _KV,
                 either("c_custkey % 2 = 0", "Purge protection: Enabled", "Purge protection: Disabled"),
                 "c_custkey", "c_name", "customer"),
        resource("IM-3", either("c_custkey % 4 <> 0", "PASS", "FAIL"), either("c_custkey % 4 <> 0", "Info", "Medium"),
                 "Microsoft.Compute/virtualMachines",
                 either("c_custkey % 4 <> 0", "Identity type: SystemAssigned", "No managed identity"),
                 "c_custkey", "c_name", "customer"),
        resource("NS-5", either("p_size % 3 = 0", "MANUAL_REVIEW", "PASS"), either("p_size % 3 = 0", "Low", "Info"), _NSG,
                 "CASE WHEN p_size % 3 = 0 THEN 'No custom rules defined' ELSE p_size % 3 || ' custom rules defined' END",
                 "p_partkey", "p_name", "part"),
        resource("LT-4", "'MANUAL_REVIEW'", "'Medium'", _NSG, "'Flow log status requires Network Watcher check'",
                 "p_partkey", "p_name", "part"),
        f"""SELECT 'LT-1', CASE WHEN p_size % 2 = 0 THEN 'PASS' ELSE 'FAIL' END,
                   CASE WHEN p_size % 2 <> 0 AND p_partkey % 4 < 3 THEN 'High' ELSE 'Medium' END, {_PLAN},
                   'Microsoft.Security/pricings', '', CASE WHEN p_size % 2 = 0 THEN 'Tier: Standard' ELSE 'Tier: Free' END
            FROM part""",
    ]
)


@query("control_predicate", PREDICATE_SQL)
def control_predicate(t: Tables) -> DataFrame:
    return evaluate(t, c.PREDICATE)


CHILDREN_SQL = """
    SELECT 'NS-1' AS control_id, CASE WHEN open <> '' THEN 'FAIL' ELSE 'PASS' END AS status,
           CASE WHEN open <> '' THEN 'Medium' ELSE 'Info' END AS severity, 'vnet' || o_orderkey AS resource_name,
           'Microsoft.Network/virtualNetworks' AS resource_type, 'rg' || o_orderkey % 7 AS resource_group,
           CASE WHEN open <> '' THEN 'Subnets without NSG: ' || open ELSE 'All subnets have NSG' END AS current_value
    FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE array_to_string(
                   list_filter([CASE WHEN o_orderstatus = 'O' THEN 'a' || o_custkey % 10 END,
                                CASE WHEN o_orderpriority = '5-LOW' THEN 'b' || o_custkey % 10 END],
                               lambda x: x IS NOT NULL), ', ') END AS open
        FROM orders
    )
    """


@query("control_children", CHILDREN_SQL)
def control_children(t: Tables) -> DataFrame:
    return evaluate(t, c.CHILDREN)


@query(
    "control_children_flat",
    """
    SELECT 'NS-1' AS control_id, CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
           CASE WHEN bad > 0 THEN 'Medium' ELSE 'Info' END AS severity, 'vnet' || o_orderkey AS resource_name,
           'Microsoft.Network/virtualNetworks' AS resource_type, 'rg' || o_orderkey % 7 AS resource_group,
           bad || ' of ' || n || ' children fail' AS current_value
    FROM (
        SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS bad
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
    )
    """,
)
def control_children_flat(t: Tables) -> DataFrame:
    networks = t.orders.selectExpr("o_orderkey AS net", resource_id("o_orderkey"), "concat('vnet', o_orderkey) AS name")
    subnets = t.lineitem.selectExpr("l_orderkey AS net", "l_linenumber", "l_returnflag")
    found = c.child_findings(
        networks,
        subnets,
        "net",
        "l_returnflag = 'R'",
        "NS-1",
        "Microsoft.Network/virtualNetworks",
        "All subnets should have NSG attached",
    )
    return found.select(*SHOWN)


@query(
    "control_children_names",
    """
    SELECT l_orderkey AS resource_key, l_linenumber || '/' || l_partkey AS child_name
    FROM lineitem WHERE l_returnflag = 'R'
    """,
)
def control_children_names(t: Tables) -> DataFrame:
    subnets = t.lineitem.withColumn("child", F.expr("concat(l_linenumber, '/', l_partkey)"))
    return c.failing_children(subnets, "l_orderkey", "child", "l_returnflag = 'R'")


RATIO_SQL = " UNION ALL ".join(
    [
        subscription(
            "AM-1",
            "PASS",
            "Info",
            "'Resources: ' || count(*) || ', Tagged: ' || count(*) FILTER (p_partkey % 3 <> 0) || ' (' || "
            "(100.0::DOUBLE * count(*) FILTER (p_partkey % 3 <> 0) / count(*))::DECIMAL(10,1) || '%)'",
            "FROM part",
        ),
        """SELECT 'AM-2', CASE WHEN pct >= 90 THEN 'PASS' ELSE 'FAIL' END,
                      CASE WHEN pct >= 90 THEN 'Info' ELSE 'Medium' END, 'Subscription', 'Subscription', '',
                      'Policy compliance: ' || pct::DECIMAL(10,1) || '%'
               FROM (SELECT 100.0::DOUBLE * count(*) FILTER (c_custkey % 8 <> 0) / count(*) AS pct FROM customer)""",
        """SELECT 'PV-1', CASE WHEN pct >= 70 THEN 'PASS' ELSE 'FAIL' END,
                      CASE WHEN pct >= 70 THEN 'Info' WHEN pct >= 50 THEN 'Medium' ELSE 'High' END, 'Subscription',
                      'Subscription', '', 'Secure Score: ' || pct::DECIMAL(10,1) || '%'
               FROM (SELECT min_by((55 + n_nationkey)::DOUBLE, n_nationkey) AS pct FROM nation)""",
    ]
)


@query("control_ratio", RATIO_SQL)
def control_ratio(t: Tables) -> DataFrame:
    return evaluate(t, c.RATIO)


ASSIGNED = """
    WITH assigned AS (
        SELECT coalesce(role_name, 'Unknown') AS role_name
        FROM orders LEFT JOIN (
            SELECT n_nationkey, ['Owner', 'Contributor', 'Owner Contributor', 'Reader'][n_nationkey % 4 + 1] AS role_name
            FROM nation) ON o_custkey % 30 = n_nationkey
    )
"""


ROLES_SQL = (
    ASSIGNED
    + """
    SELECT 'PA-1' AS control_id, CASE WHEN owners > 3 THEN 'FAIL' ELSE 'PASS' END AS status,
           CASE WHEN owners > 3 THEN 'High' ELSE 'Info' END AS severity, 'Subscription' AS resource_name,
           'Subscription' AS resource_type, '' AS resource_group, 'Owner assignments: ' || owners AS current_value
    FROM (SELECT count(*) FILTER (contains(role_name, 'Owner')) AS owners FROM assigned)
    UNION ALL
    SELECT 'PA-7', 'MANUAL_REVIEW', 'Medium', 'Subscription', 'Subscription', '',
           'Total role assignments: ' || count(*) FROM assigned
    """
)


@query("control_roles", ROLES_SQL)
def control_roles(t: Tables) -> DataFrame:
    return evaluate(t, c.ROLES)


NAMED_SQL = """
    SELECT 'ES-2' AS control_id,
           CASE WHEN c_custkey % 6 = 0 THEN 'MANUAL_REVIEW' WHEN c_custkey % 5 = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
           CASE WHEN c_custkey % 6 = 0 THEN 'High' WHEN c_custkey % 5 = 0 THEN 'Info' ELSE 'High' END AS severity,
           c_name AS resource_name, 'Microsoft.Compute/virtualMachines' AS resource_type,
           'rg' || c_custkey % 7 AS resource_group,
           CASE WHEN c_custkey % 6 = 0 THEN 'Could not check extensions'
                WHEN c_custkey % 5 = 0 THEN 'Anti-malware extension found'
                ELSE 'No anti-malware extension found' END AS current_value
    FROM customer
    UNION ALL
    SELECT control, CASE WHEN standard THEN 'PASS' ELSE 'FAIL' END, CASE WHEN standard THEN 'Info' ELSE 'High' END,
           'Subscription', 'Subscription', '',
           'Defender for Servers: ' || CASE WHEN standard THEN 'Standard' ELSE other END
    FROM (SELECT min_by(p_size % 2 = 0, p_partkey) AS standard FROM part WHERE p_partkey % 4 = 0)
    CROSS JOIN (VALUES ('PV-5', 'Not enabled'), ('ES-1', 'Not Standard')) v(control, other)
"""


@query("control_named", NAMED_SQL)
def control_named(t: Tables) -> DataFrame:
    return evaluate(t, c.NAMED)


@query(
    "control_manual",
    f"""
    WITH found AS ({EXISTENCE_SQL} UNION ALL {PREDICATE_SQL})
    SELECT status, count(*) + CASE status WHEN 'MANUAL_REVIEW' THEN 56 ELSE 0 END AS finding_count
    FROM found GROUP BY status
    """,
)
def control_manual(t: Tables) -> DataFrame:
    rules = c.Rules(
        [*c.EXISTENCE.rows, *c.PREDICATE.rows], [*c.EXISTENCE.tables, *c.PREDICATE.tables], c.ALL.manual
    )
    return evaluate(t, rules).groupBy("status").agg(F.count(F.lit(1)).alias("finding_count"))


def manual_sql() -> str:
    rows = ", ".join(f"('{control_id}')" for control_id in MANUAL_CONTROLS)
    return f"""
    SELECT control_id, 'MANUAL_REVIEW', 'Medium', 'Organization', 'Organization', '',
           'Requires ' || CASE left(control_id, 2)
               WHEN 'IM' THEN 'Entra ID' WHEN 'DP' THEN 'policy' WHEN 'LT' THEN 'configuration'
               WHEN 'IR' THEN 'organizational process' WHEN 'PV' THEN 'process' WHEN 'ES' THEN 'signature status'
               WHEN 'BR' THEN 'operational' WHEN 'DS' THEN 'DevOps process' WHEN 'GS' THEN 'strategic/policy'
               ELSE 'organizational' END
           || CASE left(control_id, 2) WHEN 'ES' THEN ' verification' ELSE ' review' END
    FROM (VALUES {rows}) v(control_id)
    """


@query(
    "evaluate_all_controls",
    " UNION ALL ".join(
        f"SELECT * FROM ({sql})"
        for sql in (EXISTENCE_SQL, PREDICATE_SQL, CHILDREN_SQL, RATIO_SQL, ROLES_SQL, NAMED_SQL, manual_sql())
    ),
)
def evaluate_all_controls(t: Tables) -> DataFrame:
    return evaluate(t, c.ALL)


def order_findings(t: Tables) -> DataFrame:
    """One finding per order: domain and control by key, status and severity
    by the order's own."""
    domains = "'NS', 'IM', 'DP', 'PA', 'AM', 'LT', 'IR', 'PV', 'ES', 'BR', 'DS', 'ZZ'"
    return t.orders.selectExpr(
        f"concat(element_at(array({domains}), cast(o_orderkey % 12 + 1 AS int)), '-', o_custkey % 9 + 1) AS control_id",
        "concat('Control ', o_custkey % 9 + 1) AS title",
        "CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'pass' ELSE 'MANUAL_REVIEW' END AS status",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'high' WHEN '3' THEN 'Medium' "
        "ELSE 'Low' END AS severity",
        "concat('order', lpad(o_orderkey, 12, '0')) AS resource_name",
        "concat('priority ', o_orderpriority) AS finding",
    )


FINDINGS = """
    WITH findings AS (
        SELECT ['NS', 'IM', 'DP', 'PA', 'AM', 'LT', 'IR', 'PV', 'ES', 'BR', 'DS', 'ZZ'][(o_orderkey % 12 + 1)::INTEGER]
                   || '-' || (o_custkey % 9 + 1) AS control_id,
               'Control ' || (o_custkey % 9 + 1) AS title,
               CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'pass' ELSE 'MANUAL_REVIEW' END AS status,
               CASE left(o_orderpriority, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'high' WHEN '3' THEN 'Medium'
                    ELSE 'Low' END AS severity,
               'order' || lpad(o_orderkey::VARCHAR, 12, '0') AS resource_name, 'priority ' || o_orderpriority AS finding
        FROM orders
    )
"""


@query(
    "findings_summary",
    FINDINGS
    + """, counts AS (
        SELECT count(*) AS total, count(*) FILTER (upper(status) = 'PASS') AS passed,
               count(*) FILTER (upper(status) = 'FAIL') AS failed,
               count(*) FILTER (upper(status) = 'MANUAL_REVIEW') AS manual,
               count(*) FILTER (status = 'FAIL' AND lower(severity) = 'critical') AS failed_critical,
               count(*) FILTER (status = 'FAIL' AND lower(severity) = 'high') AS failed_high
        FROM findings
    )
    SELECT *, round(100.0::DOUBLE * passed / total, 1) AS passed_percent,
           round(100.0::DOUBLE * failed / total, 1) AS failed_percent,
           round(100.0::DOUBLE * manual / total, 1) AS manual_percent,
           100.0::DOUBLE * passed / total AS compliance_percent
    FROM counts
    """,
)
def findings_summary(t: Tables) -> DataFrame:
    return f.findings_summary(order_findings(t))


@query(
    "findings_by_domain",
    FINDINGS
    + """, domains AS (
        SELECT * FROM (VALUES (1, 'NS', 'Network Security'), (2, 'IM', 'Identity Management'), (3, 'DP', 'Data Protection'),
            (4, 'PA', 'Privileged Access'), (5, 'AM', 'Asset Management'), (6, 'LT', 'Logging and Threat Detection'),
            (7, 'IR', 'Incident Response'), (8, 'PV', 'Posture and Vulnerability Management'),
            (9, 'ES', 'Endpoint Security'), (10, 'BR', 'Backup and Recovery'), (11, 'DS', 'DevOps Security'),
            (12, 'GS', 'Governance and Strategy'), (13, 'other', 'Other')) v(domain_order, domain, domain_name)
    ), counts AS (
        SELECT CASE WHEN split_part(control_id, '-', 1) = 'ZZ' THEN 'other' ELSE split_part(control_id, '-', 1) END
                   AS domain, count(*) AS total, count(*) FILTER (upper(status) = 'PASS') AS passed,
               count(*) FILTER (upper(status) = 'FAIL') AS failed,
               count(*) FILTER (upper(status) = 'MANUAL_REVIEW') AS manual
        FROM findings GROUP BY 1
    )
    SELECT domain_order, domain, domain_name, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed,
           coalesce(failed, 0) AS failed, coalesce(manual, 0) AS manual,
           CASE WHEN total > 0 THEN 100.0::DOUBLE * passed / total ELSE 0.0::DOUBLE END AS compliance_percent
    FROM domains LEFT JOIN counts USING (domain)
    """,
)
def findings_by_domain(t: Tables) -> DataFrame:
    return f.findings_by_domain(order_findings(t))


@query(
    "findings_urgent",
    FINDINGS
    + """
    SELECT control_id, title, severity, resource_name, finding FROM findings
    WHERE status = 'FAIL' AND lower(severity) IN ('critical', 'high')
    ORDER BY lower(severity) <> 'critical', control_id, resource_name LIMIT 10
    """,
)
def findings_urgent(t: Tables) -> DataFrame:
    return f.findings_urgent(order_findings(t))


@query(
    "findings_detail",
    FINDINGS
    + """
    SELECT *, CASE WHEN control_id LIKE 'ZZ-%' THEN 'other' ELSE split_part(control_id, '-', 1) END AS domain
    FROM findings
    """,
)
def findings_detail(t: Tables) -> DataFrame:
    return f.findings_detail(order_findings(t))


def part_catalogue(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "concat(element_at(array('NS', 'IM', 'NSX'), cast(p_partkey % 3 + 1 AS int)), '-', p_partkey) AS control_id",
        "p_name AS title",
    )


@query(
    "controls_by_domain",
    "SELECT 'NS-' || p_partkey AS control_id, p_name AS title FROM part WHERE p_partkey % 3 = 0",
)
def controls_by_domain(t: Tables) -> DataFrame:
    return f.controls_by_domain(part_catalogue(t), "ns")


@query(
    "resource_filter",
    """
    SELECT c_name AS name, 'Microsoft.Network/' || c_mktsegment AS type, 'RG3' AS resource_group FROM customer
    WHERE c_mktsegment = 'BUILDING' AND c_custkey % 7 = 3
    """,
)
def resource_filter(t: Tables) -> DataFrame:
    resources = t.customer.selectExpr(
        "c_name AS name",
        "concat('Microsoft.Network/', c_mktsegment) AS type",
        "concat('/subscriptions/s/resourceGroups/RG', c_custkey % 7, '/x') AS id",
    )
    return f.resource_filter(resources, "microsoft.network/building", "rg3").drop("id")


STATES = """
    WITH states AS (
        SELECT l_orderkey AS resource_id, 'policy' || l_linenumber AS policy_name,
               CASE l_returnflag WHEN 'R' THEN 'NonCompliant' WHEN 'A' THEN 'Compliant' END AS compliance_state
        FROM lineitem
    )
"""


def policy_states(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_orderkey AS resource_id",
        "concat('policy', l_linenumber) AS policy_name",
        "CASE l_returnflag WHEN 'R' THEN 'NonCompliant' WHEN 'A' THEN 'Compliant' END AS compliance_state",
    )


@query(
    "policy_state",
    STATES
    + """
    SELECT resource_id, count(*) AS total_policies_evaluated,
           count(*) FILTER (compliance_state = 'NonCompliant') AS non_compliant_policies,
           count(*) FILTER (compliance_state = 'NonCompliant') = 0 AS policy_compliant
    FROM states GROUP BY resource_id
    """,
)
def policy_state(t: Tables) -> DataFrame:
    return f.policy_state(policy_states(t))


@query("policy_violations", STATES + "SELECT * FROM states WHERE compliance_state = 'NonCompliant'")
def policy_violations(t: Tables) -> DataFrame:
    return f.policy_violations(policy_states(t))
