"""Evaluates rules: one pass per input, whatever the number of rules.

Schema rules run inside the file row: tables and columns stay nested, and the findings of all
three grains come out of a single ``explode``. Line rules run on a frame of lines.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.pii import classify_column
from tallyguard.functions.redaction import (
    DEFAULT_PATTERNS,
    SecretPattern,
    may_contain_secret,
    no_hits,
    redact_line,
)
from tallyguard.functions.text import explode_found, let
from tallyguard.rules.model import COLUMN, FILE, HIT, LINE, TABLE, Rule, Scope, numbered

SCHEMA_GRAINS = (FILE, TABLE, COLUMN)
ORDER_KEY = ["rule_ord", "relative_path", "table_ord", "col_ord", "line_number", "sub_ord"]
FINDING_COLUMNS = [
    "rule_id",
    "title",
    "description",
    "framework",
    "risk_tier",
    "file_path",
    "line_number",
    "table_name",
    "column_name",
    "code_snippet",
    "remediation",
    "reference",
]


_STATIC_TYPE = (
    "array<struct<rule_ord:int,case_ord:int,rule_id:string,title:string,framework:string,"
    "risk_tier:string,description:string,remediation:string,reference:string>>"
)


def _static_texts(rules: Sequence[Rule]) -> Column:
    """What does not depend on the row, one entry per case; Spark folds it into one constant."""
    entries = [
        {
            "rule_ord": rule_ord,
            "case_ord": case_ord,
            "rule_id": rule.rule_id,
            "title": rule.name,
            "framework": rule.framework,
            "risk_tier": rule.tier,
            "description": rule.description if isinstance(rule.description, str) else "",
            "remediation": rule.remediation if isinstance(rule.remediation, str) else "",
            "reference": rule.reference,
        }
        for rule, rule_ord, case_ord in numbered(rules)
    ]
    return F.from_json(F.lit(json.dumps(entries)), _STATIC_TYPE)


def _matches(rules: Sequence[Rule], grain: str, scope: Scope) -> Column:
    """array<struct<case_no, description, remediation>> of the rules of a grain that hold here;
    the texts are null unless the rule computes them."""
    nothing = F.lit(None).cast("string")

    def match(case_no: int, rule: Rule) -> Column:
        return F.struct(
            F.lit(case_no).alias("case_no"),
            (rule.description(scope) if callable(rule.description) else nothing).alias(
                "description"
            ),
            (rule.remediation(scope) if callable(rule.remediation) else nothing).alias(
                "remediation"
            ),
        )

    found = [
        F.when(rule.when(scope), match(case_no, rule))
        for case_no, rule in enumerate(rules)
        if rule.grain == grain
    ]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def _findings(
    rules: Sequence[Rule],
    grain: str,
    scope: Scope,
    static: Column,
    *,
    file_path: Column,
    table_ord: Column | None = None,
    col_ord: Column | None = None,
    line_number: Column | None = None,
    sub_ord: Column | None = None,
) -> Column:
    """array<finding> of the rules of one grain for one scope."""
    nothing = F.lit(None).cast("string")
    minus_one = F.lit(-1)

    def complete(match: Column) -> Column:
        def with_static(text: Column) -> Column:
            return F.struct(
                text["rule_ord"].alias("rule_ord"),
                scope.file["relative_path"].alias("relative_path"),
                (minus_one if table_ord is None else table_ord).alias("table_ord"),
                (minus_one if col_ord is None else col_ord).alias("col_ord"),
                (text["case_ord"] if sub_ord is None else sub_ord).alias("sub_ord"),
                text["rule_id"].alias("rule_id"),
                text["title"].alias("title"),
                F.coalesce(match["description"], text["description"]).alias("description"),
                text["framework"].alias("framework"),
                text["risk_tier"].alias("risk_tier"),
                file_path.alias("file_path"),
                (F.lit(None) if line_number is None else line_number)
                .cast("bigint")
                .alias("line_number"),
                (nothing if scope.table is None else scope.table["name"]).alias("table_name"),
                (nothing if scope.column is None else scope.column["name"]).alias("column_name"),
                F.lit("").alias("code_snippet"),
                F.coalesce(match["remediation"], text["remediation"]).alias("remediation"),
                text["reference"].alias("reference"),
            )

        return let(F.get(static, match["case_no"]), with_static)

    return F.transform(_matches(rules, grain, scope), complete)


def schema_findings(
    file: Column, tables: Column, rules: Sequence[Rule], grains: Sequence[str] = SCHEMA_GRAINS
) -> Column:
    """array<finding> of one row: file rules on ``file``, table and column rules on ``tables``."""
    static = _static_texts(rules)
    path = file["path"]

    def on_file() -> Column:
        return _findings(rules, FILE, Scope(file), static, file_path=path)

    def on_table(table: Column, table_ord: Column) -> Column:
        return _findings(
            rules, TABLE, Scope(file, table), static, file_path=path, table_ord=table_ord
        )

    def on_columns(table: Column, table_ord: Column) -> Column:
        def on_column(column: Column, col_ord: Column) -> Column:
            return let(
                classify_column(column["name"], column["data_type"]),
                lambda pii: _findings(
                    rules,
                    COLUMN,
                    Scope(file, table, column, pii),
                    static,
                    file_path=path,
                    table_ord=table_ord,
                    col_ord=col_ord,
                ),
            )

        return F.flatten(F.transform(table["columns"], on_column))

    present = {rule.grain for rule in rules} & set(grains)
    parts = []
    if FILE in present:
        parts.append(on_file())
    if TABLE in present:
        parts.append(F.flatten(F.transform(tables, on_table)))
    if COLUMN in present:
        parts.append(F.flatten(F.transform(tables, on_columns)))
    if not parts:
        never = Rule("", "", "", "", FILE, lambda s: F.lit(False), "")
        return _findings([never], FILE, Scope(file), _static_texts([never]), file_path=path)
    return F.concat(*parts)


def line_view(text: Column, hits: Column) -> Column:
    """A line in the forms the line rules look at."""
    squeezed = F.replace(text, F.lit(" "), F.lit(""))
    return F.struct(
        text.alias("text"),
        F.lower(text).alias("lower"),
        squeezed.alias("squeezed"),
        F.lower(squeezed).alias("squeezed_lower"),
        hits.alias("hits"),
    )


def with_line_view(lines: DataFrame, text: Column, hits: Column) -> DataFrame:
    """Adds ``view``. It comes out of a generator, so that filters on it stay above it instead
    of being rewritten over the raw line, which would repeat the work in every condition."""
    return lines.select("*", F.explode_outer(F.array(line_view(text, hits))).alias("view"))


def candidate_lines(
    lines: DataFrame, condition: Callable[[Column], Column], patterns: Sequence[SecretPattern]
) -> DataFrame:
    """Lines that may fulfil a condition on their redacted view, with that view.

    Redaction changes only lines with a secret; on all others the condition can be tested on the
    raw line. So the redaction runs on few lines and no line is lost.
    """
    raw = with_line_view(lines, F.col("line"), no_hits())
    kept = raw.filter(condition(F.col("view")) | may_contain_secret(F.col("view.text"), patterns))
    redacted = kept.drop("view").withColumn("redacted", redact_line(F.col("line"), patterns))
    return with_line_view(redacted, F.col("redacted.line"), F.col("redacted.hits"))


_MATCH_TYPE = "struct<case_no:int,sub_ord:int,description:string,remediation:string>"


def line_matches(
    lines: DataFrame,
    rules: Sequence[Rule],
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
    event: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(relative_path, line_number, case_no, sub_ord, description, remediation), one row per match.

    ``lines`` has relative_path, line_number, line, and is read once, whatever is asked of it:
    ``case_no`` is the place of the case in ``rules``, and texts are null unless the case computes them.
    ``event`` gives a number for a line that matters to later ones, 0 for others; such lines come out
    as matches with the negative number.
    """
    file = F.struct(F.col("relative_path").alias("relative_path"))
    case_ords = [case_ord for _, _, case_ord in numbered(rules)]

    def is_candidate(view: Column) -> Column:
        result = F.lit(False) if event is None else event(view) > 0
        for rule in rules:
            if rule.grain == LINE:
                result = result | rule.when(Scope(file, line=view))
        return result

    def match(case_no: Column, sub_ord: Column, texts: Column) -> Column:
        return F.struct(
            case_no.cast("int").alias("case_no"),
            sub_ord.cast("int").alias("sub_ord"),
            texts["description"].alias("description"),
            texts["remediation"].alias("remediation"),
        )

    def on_hit(hit: Column, position: Column) -> Column:
        found = _matches(rules, HIT, Scope(file, line=F.col("view"), hit=hit))
        return F.transform(found, lambda m: match(m["case_no"], position, m))

    parts = [F.expr(f"cast(array() as array<{_MATCH_TYPE}>)")]
    if any(rule.grain == LINE for rule in rules):
        ords = F.array(*[F.lit(n) for n in case_ords])
        found = _matches(rules, LINE, Scope(file, line=F.col("view")))
        parts.append(F.transform(found, lambda m: match(m["case_no"], F.get(ords, m["case_no"]), m)))
    if any(rule.grain == HIT for rule in rules):
        parts.append(F.flatten(F.transform(F.col("view.hits"), on_hit)))
    if event is not None:
        nothing = F.lit(None).cast("struct<description:string,remediation:string>")
        of_line = let(event(F.col("view")), lambda kind: F.array(match(-kind, F.lit(0), nothing)))
        parts.append(F.filter(of_line, lambda m: m["case_no"] < 0))
    return (
        candidate_lines(lines, is_candidate, patterns)
        .select("relative_path", "line_number", explode_found(F.concat(*parts)).alias("m"))
        .filter(F.col("m").isNotNull())
        .select("relative_path", "line_number", "m.*")
    )


def findings_of_matches(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The findings of line matches; the texts of the rules are put in here."""
    nothing = F.lit(None).cast("string")

    def complete(text: Column) -> Column:
        return F.struct(
            text["rule_ord"].alias("rule_ord"),
            F.col("relative_path").alias("relative_path"),
            F.lit(-1).alias("table_ord"),
            F.lit(-1).alias("col_ord"),
            F.col("sub_ord").alias("sub_ord"),
            text["rule_id"].alias("rule_id"),
            text["title"].alias("title"),
            F.coalesce("description", text["description"]).alias("description"),
            text["framework"].alias("framework"),
            text["risk_tier"].alias("risk_tier"),
            F.col("relative_path").alias("file_path"),
            F.col("line_number").cast("bigint").alias("line_number"),
            nothing.alias("table_name"),
            nothing.alias("column_name"),
            F.lit("").alias("code_snippet"),
            F.coalesce("remediation", text["remediation"]).alias("remediation"),
            text["reference"].alias("reference"),
        )

    found = let(F.get(_static_texts(rules), F.col("case_no")), complete)
    return matches.select(found.alias("f")).select("f.*")


def line_rule_findings(
    lines: DataFrame,
    rules: Sequence[Rule],
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """Findings of the rules that need nothing but their own line.

    ``lines`` has relative_path, line_number, line.
    """
    return findings_of_matches(line_matches(lines, rules, patterns), rules)


def findings_of_case(rows: DataFrame, rules: Sequence[Rule], case: Rule) -> DataFrame:
    """One finding per (relative_path, line_number) row, for a further case of a rule that was
    evaluated elsewhere; it comes after the cases in ``rules``."""
    with_case = [*rules, case]
    _, _, case_ord = numbered(with_case)[-1]
    no_text = F.lit(None).cast("string")
    matches = rows.select(
        "relative_path",
        "line_number",
        F.lit(len(rules)).alias("case_no"),
        F.lit(case_ord).alias("sub_ord"),
        no_text.alias("description"),
        no_text.alias("remediation"),
    )
    return findings_of_matches(matches, with_case)
