"""Text documents of any size: ordered rows that a sorted text write puts one below the other.

A document is a frame with ``section``, further sort columns and ``line``. Its part files, in
name order, are the document, so no row or task ever holds all of it. With ``by`` there is one document
per group, all of them made by the same jobs; the columns of ``by`` stand in front. What separates the
members of a list follows from the first key of each group, which is joined in the plan. Findings are
stored before their several parts are made, so the audit behind them runs once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.constants import FRAMEWORKS, TIERS
from tallyguard.operators.findings import finding_records, first_per_rule, sarif_results
from tallyguard.operators.materialise import materialise, stored
from tallyguard.operators.remediation import (
    AUDIT_LOG_STATEMENT,
    patched_files,
    remediation_statements,
    schema_trailer,
)
from tallyguard.rules.engine import FINDING_COLUMNS, ORDER_KEY

TOOL_NAME = "tallyguard"
TOOL_VERSION = "1.0.0"
_RULE = "-- " + "=" * 68
_NULLS = {"ignoreNullFields": "false"}


@dataclass(frozen=True)
class Target:
    """What was audited and when; times are ISO texts."""

    root_path: str
    fingerprint: str
    started_at: str
    completed_at: str


# the group of a document that has no group columns
_ONE = "_document"


def _by(by: Sequence[str]) -> list[str]:
    return list(by) or [_ONE]


def _grouped(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows if by else rows.withColumn(_ONE, F.lit(0))


def _groups(spark: SparkSession, by: Sequence[str], *sources: DataFrame) -> DataFrame:
    """One row per document: a group exists when any of the frames has a row of it."""
    if not by:
        return spark.range(1).select(F.lit(0).alias(_ONE))
    found = sources[0].select(*by)
    for source in sources[1:]:
        found = found.union(source.select(*by))
    return materialise(found.distinct())


def _fixed(groups: DataFrame, section: int, texts: Sequence[str]) -> DataFrame:
    lines = F.array(*[F.lit(t) for t in texts])
    return groups.select("*", F.lit(section).alias("section"), F.posexplode(lines).alias("at", "line"))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    result = F.lit(True)
    for column in columns:
        result = result & left[column].eqNullSafe(right[f"_f_{column}"])
    return result


def _mark_first(items: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Adds ``is_first``: whether a row has the smallest key of its group.

    The join is on the whole key, so a group of any size spreads over tasks.
    """
    names = [*by, *keys]
    first = (
        items.groupBy(*by)
        .agg(F.min(F.struct(*keys)).alias("k"))
        .select(*by, "k.*")
        .toDF(*[f"_f_{c}" for c in names])
        .withColumn("_f", F.lit(True))
    )
    return (
        items.join(first, _same(items, first, names), "left")
        .withColumn("is_first", F.col("_f").isNotNull())
        .drop("_f", *[f"_f_{c}" for c in names])
    )


def _list_items(
    items: DataFrame, by: Sequence[str], keys: Sequence[str], section: int, json: Column
) -> DataFrame:
    """The members of a JSON list: all but the first begin with a comma."""
    comma = F.when(F.col("is_first"), F.lit("")).otherwise(F.lit(","))
    return _mark_first(items, by, keys).select(
        *by, F.lit(section).alias("section"), *keys, F.concat(comma, json).alias("line")
    )


def _together(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    keys = [c for c in ("section", *ORDER_KEY, "at", "stmt_ord") if c in result.columns]
    result = result.select(*_by(by), *keys, "line").orderBy(*_by(by), *keys)
    return result if by else result.drop(_ONE)


def document_keys(document: DataFrame, by: Sequence[str] = ()) -> list[str]:
    """The columns that order the lines of a document."""
    return [c for c in document.columns if c != "line" and c not in by]


def write_document(document: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Writes the lines in order; the part files in name order are the document.

    With ``by`` every group has a folder of its own.
    """
    writer = document.select(*by, "line").write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def remediation_script(findings: DataFrame, target: Target, by: Sequence[str] = ()) -> DataFrame:
    """remediation.sql: a header, then the statements of every finding in finding order."""
    findings = materialise(_grouped(findings, by))
    groups = _groups(findings.sparkSession, by, findings)
    keys = _by(by)
    header = _fixed(
        groups,
        0,
        [
            _RULE,
            f"-- {TOOL_NAME}: automated SQL remediation script",
            f"-- Target: {target.root_path}",
            f"-- Fingerprint: {target.fingerprint}",
        ],
    )
    counts = findings.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.concat(F.lit("-- Total Findings: "), F.coalesce("n", F.lit(0)).cast("string"))
    count = groups.join(counts, keys, "left").select(
        *keys, F.lit(1).alias("section"), total.alias("line")
    )
    ruler = _fixed(groups, 2, [_RULE + "\n"])
    statements = remediation_statements(findings, keys).select(
        *keys, F.lit(3).alias("section"), *ORDER_KEY, "stmt_ord", F.col("statement").alias("line")
    )
    return _together([header, count, ruler, statements], by)


def fixed_schema(files: DataFrame, findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """schema.fixed.sql of every database: the .sql files with rewritten statements, a blank line
    between them, then the guards and the audit table."""
    files, findings = _grouped(files, by), materialise(_grouped(findings, by))
    keys = _by(by)
    sql_files = files.filter(F.lower("relative_path").rlike(r"[^/]\.sql\z"))
    groups = _groups(files.sparkSession, by, files)
    header = _fixed(
        groups,
        0,
        [_RULE, f"-- {TOOL_NAME}: database schema with remediations applied", _RULE + "\n"],
    )
    paths = materialise(sql_files.select(*keys, "relative_path"))
    with_sql = paths.select(*keys).distinct()
    without = groups.join(with_sql, keys, "left_anti")
    with_files = groups.join(with_sql, keys, "left_semi")
    nothing = _fixed(without, 1, ["\n-- No .sql files found to rewrite."])
    # separators are rows of their own, so texts are not joined with anything for them
    gaps = (
        _mark_first(paths, keys, ["relative_path"])
        .filter(~F.col("is_first"))
        .select(*keys, F.lit(1).alias("section"), "relative_path", F.lit(0).alias("at"), F.lit("").alias("line"))
    )
    contents = patched_files(files, findings, keys).select(
        *keys,
        F.lit(1).alias("section"),
        "relative_path",
        F.lit(1).alias("at"),
        F.col("patched_content").alias("line"),
    )
    opener = _fixed(with_files, 2, ["\n\n-- Remediation Triggers & Audit Tables"])
    guards = (
        schema_trailer(findings, keys)
        .join(with_sql, keys, "left_semi")
        .select(*keys, F.lit(3).alias("section"), "first.*", F.col("statement").alias("line"))
    )
    closing = _fixed(with_files, 4, [AUDIT_LOG_STATEMENT])
    return _together([header, nothing, gaps, contents, opener, guards, closing], by)


def sarif_document(
    findings: DataFrame, by: Sequence[str] = (), audited: DataFrame | None = None
) -> DataFrame:
    """A SARIF 2.1.0 log: one rule entry per rule id, one result per finding, in finding order.

    Groups of ``audited`` without a finding have a log without results.
    """
    findings = materialise(_grouped(findings, by))
    groups = _groups(findings.sparkSession, by, findings if audited is None else audited)
    keys = _by(by)
    opening = _fixed(
        groups,
        0,
        [
            '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0",',
            '"runs":[{"tool":{"driver":{'
            f'"name":"{TOOL_NAME}","version":"{TOOL_VERSION}","rules":[',
        ],
    )
    # Labels, tags and precision are part of the log.
    described = F.struct(
        F.col("rule_id").alias("id"),
        F.col("title").alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(F.col("description").alias("text")).alias("fullDescription"),
        F.struct(
            F.concat(
                F.lit("Remediation: "), "remediation", F.lit("\nReference: "), "reference"
            ).alias("text")
        ).alias("help"),
        F.struct(
            F.array(
                F.lit("compliance"), F.lit("financial-ledger"), F.col("framework")
            ).alias("tags"),
            F.lit("high").alias("precision"),
        ).alias("properties"),
    )
    rules = _list_items(first_per_rule(findings, keys), keys, ["rule_ord"], 1, F.to_json(described))
    between = _fixed(groups, 2, ["]}},", '"results":['])
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct("uri").alias("artifactLocation"),
                    F.struct(F.col("start_line").alias("startLine")).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
    )
    results = _list_items(sarif_results(findings, keys), keys, ORDER_KEY, 3, F.to_json(result))
    return _together([opening, rules, between, results, _fixed(groups, 4, ["]}]}"])], by)


def json_report(
    findings: DataFrame,
    summary: DataFrame,
    results: DataFrame,
    target: Target,
    by: Sequence[str] = (),
) -> DataFrame:
    """The audit report: metadata, summary, findings and rules in one JSON document per group.

    ``summary`` is the frame of ``audit_summary``, ``results`` that of ``rule_results``, both with the
    columns of ``by``. Every row of the summary has a document.
    """
    findings = stored(_grouped(findings, by))
    summary, results = materialise(_grouped(summary, by)), _grouped(results, by)
    keys = _by(by)
    groups = summary.select(*keys)
    metadata = groups.select(
        *keys,
        F.lit(1).alias("section"),
        F.to_json(
            F.struct(
                F.lit(TOOL_NAME).alias("tool"),
                F.lit(TOOL_VERSION).alias("version"),
                F.lit(target.root_path).alias("scan_target"),
                F.lit(target.fingerprint).alias("fingerprint"),
                F.lit(target.started_at).alias("scan_started_at"),
                F.lit(target.completed_at).alias("scan_completed_at"),
            )
        ).alias("line"),
    )
    per_framework = findings.groupBy(*keys).agg(
        *[F.count_if(F.col("framework") == f).alias(f"_n{i}") for i, f in enumerate(FRAMEWORKS)]
    )
    tiers = F.struct(*[F.col(f"{t.lower()}_findings").alias(t) for t, _ in TIERS])
    frameworks = F.struct(
        *[F.coalesce(f"_n{i}", F.lit(0)).alias(f) for i, f in enumerate(FRAMEWORKS)]
    )
    head = summary.join(per_framework, keys, "left").select(
        *keys,
        F.lit(3).alias("section"),
        F.to_json(
            F.struct(
                "total_files_scanned",
                "total_tables_audited",
                "total_ledger_tables_found",
                "total_secrets_redacted",
                "overall_risk_tier",
                "compliance_score",
                tiers.alias("risk_breakdown"),
                frameworks.alias("framework_breakdown"),
            )
        ).alias("line"),
    )
    # stored, so that what its join shuffles is gone before the lines are sorted
    listed = stored(
        _list_items(findings, keys, ORDER_KEY, 5, F.to_json(F.struct(*FINDING_COLUMNS), _NULLS))
    )
    rules = _list_items(
        results,
        keys,
        ["rule_ord"],
        7,
        F.to_json(F.struct("rule_id", "rule_name", "framework", "passed", "finding_count")),
    )
    return _together(
        [
            _fixed(groups, 0, ['{"metadata":']),
            metadata,
            _fixed(groups, 2, [',"summary":']),
            head,
            _fixed(groups, 4, [',"findings":[']),
            listed,
            _fixed(groups, 6, ['],"rules":[']),
            rules,
            _fixed(groups, 8, ["]}"]),
        ],
        by,
    )


def write_findings(findings: DataFrame, path: str) -> None:
    """The findings as a table, one folder per tier, for dashboards and further queries."""
    finding_records(findings).write.mode("overwrite").partitionBy("risk_tier").parquet(path)
