"""Counts and scores over findings and audited files.

All of them combine before the shuffle and end in a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.constants import FRAMEWORKS, TIERS
from tallyguard.rules.model import Rule, numbered, rules_frame


def tier_weight(tier: Column) -> Column:
    weight = F.lit(0)
    for name, value in TIERS:
        weight = F.when(tier == name, F.lit(value)).otherwise(weight)
    return weight


def _zero_filled(counts: DataFrame, key: str, values: Sequence[str], spark: SparkSession):
    dimension = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(v) for v in values])).alias("ord", key)
    )
    # the dimension is a fixed list, and the counts have one row per value that occurs
    return (
        dimension.join(F.broadcast(counts), key, "left")
        .select("ord", key, F.coalesce("finding_count", F.lit(0)).alias("finding_count"))
        .orderBy("ord")
        .drop("ord")
    )


def risk_summary(findings: DataFrame) -> DataFrame:
    """(risk_tier, finding_count) for all four tiers."""
    counts = findings.groupBy("risk_tier").agg(F.count("*").alias("finding_count"))
    return _zero_filled(counts, "risk_tier", [t for t, _ in TIERS], findings.sparkSession)


def framework_summary(findings: DataFrame) -> DataFrame:
    """(framework, finding_count) for all frameworks."""
    counts = findings.groupBy("framework").agg(F.count("*").alias("finding_count"))
    return _zero_filled(counts, "framework", FRAMEWORKS, findings.sparkSession)


def tab_counts(findings: DataFrame) -> DataFrame:
    """(risk_tier or 'ALL', finding_count): one aggregation for the total and every tier."""
    tiers = [t for t, _ in TIERS]
    counts = (
        findings.rollup("risk_tier")
        .agg(F.count("*").alias("finding_count"))
        .select(F.coalesce("risk_tier", F.lit("ALL")).alias("risk_tier"), "finding_count")
    )
    return _zero_filled(counts, "risk_tier", ["ALL", *tiers], findings.sparkSession)


def rule_results(
    findings: DataFrame,
    rules: Sequence[Rule],
    by: Sequence[str] = (),
    groups: DataFrame | None = None,
) -> DataFrame:
    """(by, rule_ord, rule_id, rule_name, framework, passed, finding_count), every rule listed.

    With ``by`` every group has all rules; ``groups`` names those that may have no finding.
    """
    counts = findings.groupBy(*by, "rule_id").agg(F.count("*").alias("n"))
    listed = rules_frame(findings.sparkSession, rules)
    if by:
        # a row per group and rule: the rules are a fixed list
        known = F.array(
            *[
                F.struct(
                    F.lit(rule_ord).alias("rule_ord"),
                    F.lit(rule.rule_id).alias("rule_id"),
                    F.lit(rule.name).alias("rule_name"),
                    F.lit(rule.framework).alias("framework"),
                )
                for rule, rule_ord, case in numbered(rules)
                if case == 0
            ]
        )
        of_groups = (findings if groups is None else groups).select(*by).distinct()
        listed = of_groups.select(*by, F.inline(known))
        joined = listed.join(counts, [*by, "rule_id"], "left")
    else:
        joined = listed.join(F.broadcast(counts), "rule_id", "left")
    return joined.select(
        *by,
        "rule_ord",
        "rule_id",
        "rule_name",
        "framework",
        F.col("n").isNull().alias("passed"),
        F.coalesce("n", F.lit(0)).alias("finding_count"),
    )


def overall_tier(findings: DataFrame) -> DataFrame:
    """One row: the heaviest tier, LOW when there is no finding."""
    return findings.agg(
        F.coalesce(
            F.max_by("risk_tier", tier_weight(F.col("risk_tier"))), F.lit("LOW")
        ).alias("overall_risk_tier")
    )


def compliance_score(results: DataFrame) -> DataFrame:
    """One row: percentage of passed rules with one decimal, 100 when there are no rules."""
    return results.agg(
        F.coalesce(
            F.round(F.avg(F.when(F.col("passed"), 100.0).otherwise(0.0)), 1), F.lit(100.0)
        ).alias("compliance_score")
    )


def _flags(rules: Sequence[Rule]) -> list[str]:
    return [r.rule_id for r, _, case in numbered(rules) if case == 0]


def _counted(
    rows: DataFrame,
    rules: Sequence[Rule],
    by: Sequence[str],
    files: Column | int = 0,
    tables: Column | int = 0,
    ledgers: Column | int = 0,
    secrets: Column | int = 0,
    findings: Column | None = None,
) -> DataFrame:
    """What one row adds to the counters; ``findings`` are an array in the row."""

    def number(value: Column | int) -> Column:
        return (F.lit(value) if isinstance(value, int) else value).cast("bigint")

    def having(field: str, value: str) -> Column:
        if findings is None:
            return F.lit(0).cast("bigint")
        return F.size(F.filter(findings, lambda f: f[field] == value)).cast("bigint")

    return rows.select(
        *by,
        number(files).alias("total_files_scanned"),
        number(tables).alias("total_tables_audited"),
        number(ledgers).alias("total_ledger_tables_found"),
        number(secrets).alias("total_secrets_redacted"),
        number(0 if findings is None else F.size(findings)).alias("total_findings"),
        *[having("risk_tier", t).alias(f"{t.lower()}_findings") for t, _ in TIERS],
        *[
            F.least(having("rule_id", r), F.lit(1)).alias(f"_r{i}")
            for i, r in enumerate(_flags(rules))
        ],
    )


def _totals(counted: DataFrame, rules: Sequence[Rule], by: Sequence[str]) -> DataFrame:
    """The sums of the counters, with the overall tier, the score and the rules that failed."""
    rule_ids = _flags(rules)
    tiers = [f"{t.lower()}_findings" for t, _ in TIERS]
    counters = [
        "total_tables_audited",
        "total_ledger_tables_found",
        "total_secrets_redacted",
        "total_findings",
        *tiers,
    ]
    zero = F.lit(0).cast("bigint")
    totals = counted.groupBy(*by).agg(
        F.coalesce(F.sum("total_files_scanned"), zero).alias("total_files_scanned"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in counters],
        *[F.coalesce(F.max(f"_r{i}"), zero).alias(f"_r{i}") for i in range(len(rule_ids))],
    )
    overall = F.lit("LOW")
    for tier, _ in reversed(TIERS):
        overall = F.when(F.col(f"{tier.lower()}_findings") > 0, F.lit(tier)).otherwise(overall)
    failed = F.lit(0)
    for i in range(len(rule_ids)):
        failed = failed + F.col(f"_r{i}")
    score = (
        F.round((F.lit(len(rule_ids)) - failed) * 100.0 / len(rule_ids), 1)
        if rule_ids
        else F.lit(100.0)
    )
    failed_ids = [F.when(F.col(f"_r{i}") > 0, F.lit(r)) for i, r in enumerate(rule_ids)]
    return totals.select(
        *by,
        "total_files_scanned",
        *counters,
        overall.alias("overall_risk_tier"),
        score.cast("double").alias("compliance_score"),
        F.array_compact(F.array(*failed_ids)).cast("array<string>").alias("failed_rules"),
    )


def _counted_files(audited: DataFrame, rules: Sequence[Rule], by: Sequence[str]) -> DataFrame:
    ledgers = F.filter("tables", lambda t: t["is_ledger_table"])
    return _counted(
        audited,
        rules,
        by,
        files=1,
        tables=F.size("tables"),
        ledgers=F.size(ledgers),
        secrets=F.size("redacted.hits"),
        findings=F.col("findings"),
    )


def audit_summary(
    audited: DataFrame,
    rules: Sequence[Rule],
    by: Sequence[str] = (),
    with_failed_rules: bool = False,
) -> DataFrame:
    """The counters of an audit, one row (or one row per group), from one aggregation.

    Takes the audited files frame; the findings are counted inside their file row, so nothing is
    exploded or joined, and a group may have any size.
    """
    totals = _totals(_counted_files(audited, rules, by), rules, by)
    return totals if with_failed_rules else totals.drop("failed_rules")


def audit_summary_with_final_schema(
    audited: DataFrame,
    chains: DataFrame,
    final_tables: DataFrame,
    final_findings: DataFrame,
    rules: Sequence[Rule],
    by: Sequence[str],
) -> DataFrame:
    """The counters of the files and of the replayed schema of every chain, as one more file each.

    ``chains`` are the facts of the chains of several files, ``final_tables`` and
    ``final_findings`` what their replay gives. A chain is never gathered: its tables and findings
    add to the same sums row by row.
    """
    return _with_final_schema(
        _counted_files(audited, rules, by), chains, final_tables, final_findings, rules, by
    )


def file_counts(audited: DataFrame) -> Column:
    """struct<tables, ledgers, secrets, findings>: what the counters need to know about a file."""
    ledgers = F.filter(audited["tables"], lambda t: t["is_ledger_table"])
    findings = F.transform(
        audited["findings"],
        lambda f: F.struct(f["rule_id"].alias("rule_id"), f["risk_tier"].alias("risk_tier")),
    )
    return F.struct(
        F.size(audited["tables"]).alias("tables"),
        F.size(ledgers).alias("ledgers"),
        F.size(audited["redacted"]["hits"]).alias("secrets"),
        findings.alias("findings"),
    )


def summary_of_counts(
    counts: DataFrame,
    chains: DataFrame,
    final_tables: DataFrame,
    final_findings: DataFrame,
    rules: Sequence[Rule],
    by: Sequence[str],
) -> DataFrame:
    """The same as :func:`audit_summary_with_final_schema`, from the :func:`file_counts` of the files."""
    counted = _counted(
        counts,
        rules,
        by,
        files=1,
        tables=F.col("tables"),
        ledgers=F.col("ledgers"),
        secrets=F.col("secrets"),
        findings=F.col("findings"),
    )
    return _with_final_schema(counted, chains, final_tables, final_findings, rules, by)


def _with_final_schema(
    counted_files: DataFrame,
    chains: DataFrame,
    final_tables: DataFrame,
    final_findings: DataFrame,
    rules: Sequence[Rule],
    by: Sequence[str],
) -> DataFrame:
    chains = chains.select(*by, "secret_count")
    tables = final_tables.join(chains.select(*by), list(by), "left_semi")
    finding = F.array(F.struct("rule_id", "risk_tier"))
    parts = [
        counted_files,
        _counted(chains, rules, by, files=1, secrets=F.col("secret_count")),
        _counted(tables, rules, by, tables=1, ledgers=F.col("is_ledger_table").cast("int")),
        _counted(final_findings, rules, by, findings=finding),
    ]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return _totals(counted, rules, by).drop("failed_rules")
