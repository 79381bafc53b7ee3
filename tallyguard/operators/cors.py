"""Wildcard origins inside of a CORS block: a state that is carried from line to line.

An opener line opens the block of its file. A wildcard line inside the block is a finding and
closes it. Among the lines that open or are wildcards, a wildcard line therefore fires exactly if
it opens the block itself, or if the line before it (among these) opened without being a wildcard.
So the state is one flag of the previous event line.

A file may hold any share of all lines, so no window spans a whole file. Lines are put into blocks by
their number. A block by itself gives its first event, the findings that follow from its own events, and
its last event; two neighbouring blocks merge into one of the same form, since all that passes between
them is the last event of the one and the first event of the other. So only one row per block is carried
along a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.functions.redaction import DEFAULT_PATTERNS, SecretPattern
from tallyguard.functions.text import explode_found, let
from tallyguard.rules.catalog import CORS_BLOCK_CASE, opens_cors_block, wildcard_in_block
from tallyguard.rules.engine import findings_of_case, line_matches
from tallyguard.rules.model import Rule

LINES_PER_BLOCK = 100_000

OPENS, WILDCARD = 1, 2


def cors_event(view: Column) -> Column:
    """What a line means for the state: 0 nothing, or the sum of OPENS and WILDCARD."""
    return F.when(opens_cors_block(view), OPENS).otherwise(0) + F.when(
        wildcard_in_block(view), WILDCARD
    ).otherwise(0)


def fires(kind: Column, previous: Column) -> Column:
    """Whether an event is a finding, given the kind of the event before it."""
    return (kind == OPENS + WILDCARD) | ((kind == WILDCARD) & (previous == OPENS))


def block_states(events: DataFrame, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """(relative_path, block, first, found, last) over (relative_path, line_number, kind) events.

    ``first`` and ``last`` are events, ``found`` the line numbers of the findings after the first one. A
    block has at most as many events as lines.
    """
    gathered = (
        events.withColumn("block", F.expr(f"line_number div {lines_per_block}"))
        .groupBy("relative_path", "block")
        .agg(F.array_sort(F.collect_list(F.struct("line_number", "kind"))).alias("events"))
    )

    def found(own: Column) -> Column:
        after = F.transform(
            own,
            lambda e, i: F.when(
                (i > 0) & fires(e["kind"], F.get(own, i - 1)["kind"]), e["line_number"]
            ),
        )
        return F.array_compact(after)

    return gathered.select(
        "relative_path",
        "block",
        F.get("events", F.lit(0)).alias("first"),
        let(F.col("events"), found).alias("found"),
        F.element_at("events", -1).alias("last"),
    )


def merged_findings(states: DataFrame) -> DataFrame:
    """(relative_path, line_number) of the findings over all blocks of each file."""
    carried = F.lag("last").over(Window.partitionBy("relative_path").orderBy("block"))["kind"]
    at_border = F.when(
        fires(F.col("first.kind"), F.coalesce("carried", F.lit(0))), F.array("first.line_number")
    ).otherwise(F.array().cast("array<bigint>"))
    return (
        states.withColumn("carried", carried)
        .select("relative_path", explode_found(F.concat("found", at_border)).alias("line_number"))
        .filter(F.col("line_number").isNotNull())
    )


def findings_of_events(
    matches: DataFrame, rules: Sequence[Rule], lines_per_block: int = LINES_PER_BLOCK
) -> DataFrame:
    """Findings of the block case, from the matches that :func:`cors_event` gave."""
    events = matches.filter("case_no < 0").select(
        "relative_path", "line_number", (-F.col("case_no")).alias("kind")
    )
    fired = merged_findings(block_states(events, lines_per_block))
    return findings_of_case(fired, rules, CORS_BLOCK_CASE)


def cors_block_findings(
    lines: DataFrame,
    rules: Sequence[Rule],
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
    lines_per_block: int = LINES_PER_BLOCK,
) -> DataFrame:
    """Findings of the block case of CBN-002 alone, over (relative_path, line_number, line)."""
    return findings_of_events(line_matches(lines, [], patterns, cors_event), rules, lines_per_block)
