"""What a rule is: a grain, a condition and the texts of its finding."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, TABLE, COLUMN, LINE, HIT = "file", "table", "column", "line", "hit"


@dataclass(frozen=True)
class Scope:
    """The columns a condition may look at; which ones are set depends on the grain.

    file   : struct<relative_path, path, has_cascade_text, mentions_privileged_user,
             has_ledger_table, has_audit_table>
    table  : struct<name, columns, constraints, triggers, is_ledger_table>
    column : struct<name, data_type, ...>, with ``pii`` its classification
    line   : struct<text, lower, squeezed, squeezed_lower, hits> (text is redacted)
    hit    : one redaction hit of the line
    """

    file: Column
    table: Column | None = None
    column: Column | None = None
    pii: Column | None = None
    line: Column | None = None
    hit: Column | None = None


Text = str | Callable[[Scope], Column]


@dataclass(frozen=True)
class Rule:
    """One rule, or one case of a rule: cases share ``rule_id`` and follow one another."""

    rule_id: str
    name: str
    framework: str
    tier: str
    grain: str
    when: Callable[[Scope], Column]
    description: Text
    remediation: Text = ""
    reference: str = ""


def numbered(rules: Sequence[Rule]) -> list[tuple[Rule, int, int]]:
    """(rule, rule_ord, case_ord): the order of rules, and of the cases within one rule."""
    first_seen: dict[str, int] = {}
    cases: dict[str, int] = {}
    result = []
    for rule in rules:
        rule_ord = first_seen.setdefault(rule.rule_id, len(first_seen))
        case_ord = cases.get(rule.rule_id, 0)
        cases[rule.rule_id] = case_ord + 1
        result.append((rule, rule_ord, case_ord))
    return result


def by_framework(rules: Sequence[Rule], framework: str) -> list[Rule]:
    return [rule for rule in rules if rule.framework == framework]


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rule_ord, rule_id, rule_name, framework), one row per rule id; its size is that of the
    rule list, so it can always be broadcast."""
    rows = [
        F.struct(
            F.lit(rule_ord).alias("rule_ord"),
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.name).alias("rule_name"),
            F.lit(rule.framework).alias("framework"),
        )
        for rule, rule_ord, case_ord in numbered(rules)
        if case_ord == 0
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
