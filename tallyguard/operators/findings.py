"""Queries over a findings frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.summaries import tier_weight
from tallyguard.rules.engine import FINDING_COLUMNS, ORDER_KEY

NOT_AVAILABLE = "N/A"


def _or_na(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(NOT_AVAILABLE))


def by_severity() -> list[Column]:
    """Sort order: heaviest tier first, the order of the findings within a tier."""
    return [tier_weight(F.col("risk_tier")).desc(), *[F.col(c).asc() for c in ORDER_KEY]]


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*by_severity())


def filter_findings(findings: DataFrame, tier: str = "ALL", query: str = "") -> DataFrame:
    """Findings of one tier (or ALL) whose title, rule id, table or description holds the text."""
    if tier != "ALL":
        findings = findings.filter(F.col("risk_tier") == tier)
    needle = query.lower()
    if not needle:
        return findings
    found = F.lit(False)
    for column in ("title", "rule_id", "table_name", "description"):
        found = found | F.lower(F.coalesce(column, F.lit(""))).contains(needle)
    return findings.filter(found)


def finding_details(findings: DataFrame) -> DataFrame:
    """The detail view: missing table, column and line shown as N/A, heaviest first."""
    return sorted_findings(findings).select(
        "rule_id",
        "risk_tier",
        "framework",
        _or_na("table_name").alias("table_name"),
        _or_na("column_name").alias("column_name"),
        "file_path",
        F.coalesce(
            F.nullif(F.col("line_number"), F.lit(0)).cast("string"), F.lit(NOT_AVAILABLE)
        ).alias("line_number"),
        "code_snippet",
        "remediation",
    )


def remediation_matrix(findings: DataFrame) -> DataFrame:
    """(rule_id, table_name or N/A, risk_tier, remediation), heaviest first."""
    return sorted_findings(findings).select(
        "rule_id", _or_na("table_name").alias("table_name"), "risk_tier", "remediation"
    )


def finding_records(findings: DataFrame) -> DataFrame:
    """The twelve public fields of a finding, without the order key."""
    return findings.select(*FINDING_COLUMNS)


def first_per_rule(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first finding of every rule (of every group), in finding order.

    The smallest keys are found first, from the keys alone and combined before the shuffle; the findings
    with these keys are then taken. ``findings`` are read twice, so store what is costly to make.
    """
    names = [*by, "rule_id", *ORDER_KEY]
    first = (
        findings.groupBy(*by, "rule_id")
        .agg(F.min(F.struct(*ORDER_KEY)).alias("k"))
        .select(*by, "rule_id", "k.*")
        .toDF(*[f"_f_{c}" for c in names])
    )
    same = [findings[c].eqNullSafe(first[f"_f_{c}"]) for c in names]
    return findings.join(first, same, "left_semi")


def rules_per_table(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(table_name, rule_ids sorted): the distinct rules a table breaks.

    A set of rule ids has at most as many members as there are rules.
    """
    return (
        findings.filter(F.coalesce("table_name", F.lit("")) != "")
        .groupBy(*(by or []), "table_name")
        .agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    )


def sarif_level(tier: Column) -> Column:
    return (
        F.when(tier.isin("CRITICAL", "HIGH"), F.lit("error"))
        .when(tier == "MEDIUM", F.lit("warning"))
        .otherwise(F.lit("note"))
    )


def sarif_results(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, order key, rule_id, level, message, uri, start_line), one row per finding."""
    return findings.select(
        *by,
        *ORDER_KEY,
        "rule_id",
        sarif_level(F.col("risk_tier")).alias("level"),
        F.concat(
            F.col("description"), F.lit(" (Table: "), _or_na("table_name"), F.lit(")")
        ).alias("message"),
        F.col("file_path").alias("uri"),
        F.coalesce(F.nullif(F.col("line_number"), F.lit(0)), F.lit(1)).alias("start_line"),
    )
