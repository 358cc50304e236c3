"""Roll-ups of findings: totals, domains, urgent list, details, policy states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.functions.control_catalogue import DOMAINS, FAIL, MANUAL_REVIEW, PASS
from drayage.operators.controls import RESOURCE_GROUP

OTHER = "other"


def domain_of(control_id: Column) -> Column:
    """The prefix before the dash, or ``other`` where it names no domain."""
    prefix = F.when(F.contains(control_id, F.lit("-")), F.substring_index(control_id, "-", 1))
    return F.when(prefix.isin(*DOMAINS), prefix).otherwise(F.lit(OTHER))


def _status_is(value: str) -> Column:
    return F.upper("status") == value


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.lit(100.0) * F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(_status_is(PASS)).alias("passed"),
        F.count_if(_status_is(FAIL)).alias("failed"),
        F.count_if(_status_is(MANUAL_REVIEW)).alias("manual"),
    ]


def findings_summary(findings: DataFrame) -> DataFrame:
    """One row: counts, shares, failed critical and high findings."""
    failed = _status_is(FAIL)
    totals = findings.agg(
        *_counts(),
        F.count_if(failed & (F.lower("severity") == "critical")).alias("failed_critical"),
        F.count_if(failed & (F.lower("severity") == "high")).alias("failed_high"),
    )
    return totals.withColumns(
        {
            "passed_percent": F.round(_share("passed", "total"), 1),
            "failed_percent": F.round(_share("failed", "total"), 1),
            "manual_percent": F.round(_share("manual", "total"), 1),
            "compliance_percent": _share("passed", "total"),
        }
    )


def findings_by_domain(findings: DataFrame) -> DataFrame:
    """One row per domain in report order, also without findings, then ``other``."""
    names = [(i, d, name) for i, (d, name) in enumerate([*DOMAINS.items(), (OTHER, "Other")], start=1)]
    domains = findings.sparkSession.createDataFrame(names, "domain_order int, domain string, domain_name string")
    counts = findings.groupBy(domain_of(F.col("control_id")).alias("domain")).agg(*_counts())
    joined = domains.join(counts, "domain", "left").fillna(0, ["total", "passed", "failed", "manual"])
    return joined.withColumn("compliance_percent", _share("passed", "total")).orderBy("domain_order")


def findings_urgent(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The first critical, then high, failures by control id, as a top-k."""
    urgent = findings.filter(_status_is(FAIL) & F.lower("severity").isin("critical", "high"))
    rank = F.when(F.lower("severity") == "critical", 0).otherwise(1)
    ordered = urgent.orderBy(rank, "control_id", "resource_name").limit(limit)
    return ordered.select("control_id", "title", "severity", "resource_name", "finding")


def findings_detail(findings: DataFrame) -> DataFrame:
    """All findings with their domain, sorted by domain, control and resource."""
    return findings.withColumn("domain", domain_of(F.col("control_id"))).orderBy(
        "domain", "control_id", "resource_name"
    )


def write_findings_detail(findings: DataFrame, path: str) -> None:
    """A folder per domain. The sort spreads a large domain over many files."""
    findings_detail(findings).write.mode("overwrite").partitionBy("domain").parquet(path)


def controls_by_domain(catalogue: DataFrame, domain: str = "") -> DataFrame:
    """Control definitions of a domain; all if none is named."""
    return catalogue.filter(F.col("control_id").startswith(f"{domain.upper()}-")) if domain else catalogue


def resource_filter(resources: DataFrame, resource_type: str = "", group: str = "") -> DataFrame:
    """Resources by type and group, ignoring case; empty text means all."""
    out = resources.withColumn("resource_group", F.expr(RESOURCE_GROUP))
    if resource_type:
        out = out.filter(F.lower("type") == resource_type.lower())
    if group:
        out = out.filter(F.lower("resource_group") == group.lower())
    return out


_NOT_COMPLIANT = "coalesce(compliance_state, '') NOT IN ('', 'Compliant')"


def policy_state(states: DataFrame, by: Sequence[str] = ("resource_id",)) -> DataFrame:
    """Per resource: policies evaluated, those not met, overall verdict."""
    counted = states.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_policies_evaluated"),
        F.count_if(F.expr(_NOT_COMPLIANT)).alias("non_compliant_policies"),
    )
    return counted.withColumn("policy_compliant", F.col("non_compliant_policies") == 0)


def policy_violations(states: DataFrame, by: Sequence[str] = ("resource_id",)) -> DataFrame:
    """One row per policy a resource does not meet."""
    return states.filter(F.expr(_NOT_COMPLIANT)).select(*by, "policy_name", "compliance_state")
