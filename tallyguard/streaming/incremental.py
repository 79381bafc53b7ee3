"""Incremental runs: texts that arrive over time go through the same projections as a batch.

Redaction, the schema rules and most line rules look at one row only, so they need neither state nor
watermarks. The rule that carries a state from line to line (operators.cors) keeps it per file across
batches. The replay of migrations needs all rows of a database and stays a batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyguard.operators.cors import OPENS, WILDCARD, cors_event
from tallyguard.operators.redaction import redact
from tallyguard.plans.audit import audited_files, findings_of
from tallyguard.rules.catalog import CORS_BLOCK_CASE, LINE_RULES, SCHEMA_RULES
from tallyguard.rules.engine import findings_of_case, line_matches, line_rule_findings
from tallyguard.rules.model import Rule
from tallyguard.sources.files import with_engine


def _append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is new since the last run, each row written once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_redacted(texts: DataFrame, text_col: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the redacted texts, without the originals, to a parquet table."""
    return _append(redact(texts, text_col).drop(text_col), path, checkpoint)


def append_findings(
    files: DataFrame, path: str, checkpoint: str, rules: Sequence[Rule] = SCHEMA_RULES
) -> StreamingQuery:
    """Appends the schema findings of new (relative_path, content) rows to a parquet table."""
    return _append(findings_of(audited_files(with_engine(files), rules)), path, checkpoint)


class _CorsState(StatefulProcessor):
    """The last event of every file, kept from one batch of lines to the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "kind int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values("line_number")
        known = self.last.get()
        before = events["kind"].shift(1, fill_value=known[0] if known else 0)
        kinds = events["kind"]
        fired = (kinds == OPENS + WILDCARD) | ((kinds == WILDCARD) & (before == OPENS))
        self.last.update((int(kinds.iloc[-1]),))
        yield pd.DataFrame({"relative_path": key[0], "line_number": events["line_number"][fired]})

    def close(self) -> None:
        pass


def line_findings_of_stream(lines: DataFrame, rules: Sequence[Rule] = LINE_RULES) -> DataFrame:
    """The line rules over a stream of (relative_path, line_number, line).

    The rule with a state from line to line keeps one number per file, in the state store (RocksDB). The
    lines of a file have to arrive in their order, cut into batches anywhere; a line that comes later
    than its successors is judged by what has come before it. A file without a path is left out.
    """
    own = line_rule_findings(lines, rules)
    if all(rule.rule_id != CORS_BLOCK_CASE.rule_id for rule in rules):
        return own
    events = (
        line_matches(lines, [], event=cors_event)
        .filter(F.col("relative_path").isNotNull())
        .select("relative_path", "line_number", (-F.col("case_no")).alias("kind"))
    )
    fired = events.groupBy("relative_path").transformWithStateInPandas(
        _CorsState(), "relative_path string, line_number long", "Append", "None"
    )
    return own.unionByName(findings_of_case(fired, rules, CORS_BLOCK_CASE))


def append_line_findings(
    lines: DataFrame, path: str, checkpoint: str, rules: Sequence[Rule] = LINE_RULES
) -> StreamingQuery:
    """Appends the findings of new lines to a parquet table; the state is part of the checkpoint."""
    lines.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return _append(line_findings_of_stream(lines, rules), path, checkpoint)
