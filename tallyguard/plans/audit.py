"""The audit of a corpus: files in, findings and summaries out.

``audited_files`` is one projection over the files frame: extraction, redaction and all schema
rules happen inside the file row, so the text is read and searched once and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.constants import LEDGER_WORDS
from tallyguard.functions.ddl import schema_tables
from tallyguard.functions.facts import (
    has_audit_table,
    has_cascade_text,
    has_ledger_table,
    mentions_privileged_user,
)
from tallyguard.functions.redaction import DEFAULT_PATTERNS, SecretPattern, redact_text
from tallyguard.functions.text import explode_found
from tallyguard.operators.cors import cors_event, findings_of_events
from tallyguard.operators.materialise import materialise
from tallyguard.operators.redaction import explode_lines
from tallyguard.rules.catalog import CORS_BLOCK_CASE, LINE_RULES, SCHEMA_RULES
from tallyguard.rules.engine import findings_of_matches, line_matches, line_rule_findings, schema_findings
from tallyguard.rules.model import Rule

def audited_files(
    files: DataFrame,
    rules: Sequence[Rule] = SCHEMA_RULES,
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
    ledger_words: Sequence[str] = LEDGER_WORDS,
) -> DataFrame:
    """Adds tables, redacted (struct<text, hits>), facts and findings (array) to every file."""
    facts = F.struct(
        F.col("relative_path").alias("relative_path"),
        F.col("path").alias("path"),
        has_cascade_text(F.col("raw_content"), F.col("redacted.text")).alias("has_cascade_text"),
        mentions_privileged_user(F.col("raw_content")).alias("mentions_privileged_user"),
        has_ledger_table(F.col("tables")).alias("has_ledger_table"),
        has_audit_table(F.col("tables")).alias("has_audit_table"),
    )
    return (
        files.withColumn(
            "tables", schema_tables(F.col("engine_type"), F.col("raw_content"), ledger_words)
        )
        .withColumn("redacted", redact_text(F.col("raw_content"), patterns))
        .withColumn("facts", facts)
        .withColumn("findings", schema_findings(F.col("facts"), F.col("tables"), rules))
    )


def findings_of(audited: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """One row per finding, with the order key of the findings in front."""
    return (
        audited.select(*id_cols, explode_found(F.col("findings")).alias("f"))
        .filter(F.col("f").isNotNull())
        .select(*id_cols, "f.*")
    )


def line_findings(
    lines: DataFrame,
    rules: Sequence[Rule] = LINE_RULES,
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """Findings of the line rules over (relative_path, line_number, line).

    The lines are read and searched once. Where the rule with a state from line to line is asked for,
    the matches, a few numbers each, are stored: its events then go on to their blocks.
    """
    if all(rule.rule_id != CORS_BLOCK_CASE.rule_id for rule in rules):
        return line_rule_findings(lines, rules, patterns)
    matches = materialise(line_matches(lines, rules, patterns, cors_event))
    own = findings_of_matches(matches.filter("case_no >= 0"), rules)
    return own.unionByName(findings_of_events(matches, rules))


def line_findings_of_files(
    files: DataFrame,
    rules: Sequence[Rule] = LINE_RULES,
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """The same for a files frame, one row per file."""
    return line_findings(explode_lines(files, "raw_content", ["relative_path"]), rules, patterns)
