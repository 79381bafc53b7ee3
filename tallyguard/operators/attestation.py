"""The attestation record: a hash chain over the rule results of an audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.attestation import claim, signature, verifier_hash
from tallyguard.operators.merkle import root_of_array
from tallyguard.operators.summaries import audit_summary
from tallyguard.rules.model import Rule, numbered

VERSION = "2.0.0-ZK"


def rule_claims(results: DataFrame) -> DataFrame:
    """(rule_ord, claim): one text per rule result, without anything about the schema."""
    return results.select(
        "rule_ord",
        claim(F.col("rule_id"), F.col("passed"), F.col("framework")).alias("claim"),
    )


def _record(
    rows: DataFrame, rule_count: int, fingerprint: str, completed_at: str, salt: str
) -> DataFrame:
    """The nine fields of the record, from rows with claims and the counters."""
    hashed = rows.withColumn("merkle_root", root_of_array(F.col("claims"), rule_count)).select(
        F.lit(VERSION).alias("zk_proof_version"),
        F.lit(fingerprint).alias("target_fingerprint"),
        F.lit(completed_at).alias("timestamp"),
        "merkle_root",
        "compliance_score",
        "overall_risk_tier",
        F.col("total_findings").alias("total_findings_count"),
    )
    return hashed.withColumn(
        "zero_knowledge_verifier_hash",
        verifier_hash(
            salt, F.col("target_fingerprint"), F.col("merkle_root"), F.col("compliance_score")
        ),
    ).withColumn(
        "proof_signature", signature(F.col("zero_knowledge_verifier_hash"), F.col("timestamp"))
    )


def attest(
    audited: DataFrame,
    rules: Sequence[Rule],
    fingerprint: str,
    completed_at: str,
    salt: str,
) -> DataFrame:
    """One row with the nine fields of the record; summary and claims come from one aggregation."""
    summary = audit_summary(audited, rules, with_failed_rules=True)
    listed = [(r.rule_id, r.framework) for r, _, case in numbered(rules) if case == 0]
    claims = F.array(
        *[
            claim(F.lit(rule), ~F.array_contains("failed_rules", rule), F.lit(framework))
            for rule, framework in listed
        ]
    )
    rows = summary.withColumn("claims", claims)
    return _record(rows, len(listed), fingerprint, completed_at, salt)
