"""The audit of migration chains together with the schemas they lead to, from one reading of the files.

One generator gives, for every file, a row with its facts and counts and a row per schema event. These
rows are stored; the replay, the facts of the chains, the findings of the final schemas and the counters
all come from them, so the texts are read and searched once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.redaction import DEFAULT_PATTERNS, SecretPattern
from tallyguard.functions.text import explode_found
from tallyguard.operators.materialise import stored as materialise
from tallyguard.operators.replay import (
    chain_facts_of_files,
    events_of_file,
    findings_of_chains,
    replay_events,
)
from tallyguard.operators.summaries import file_counts, summary_of_counts
from tallyguard.plans.audit import audited_files
from tallyguard.rules.catalog import SCHEMA_RULES
from tallyguard.rules.model import Rule


def files_and_events(
    files: DataFrame,
    by: Sequence[str],
    rules: Sequence[Rule] = SCHEMA_RULES,
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """(by, relative_path, path, engine_type, file, event): of ``file`` and ``event`` one is set."""
    audited = audited_files(files, rules, patterns)
    facts = F.struct(
        file_counts(audited).alias("counts"),
        F.col("facts.has_cascade_text").alias("has_cascade_text"),
        F.col("facts.mentions_privileged_user").alias("mentions_privileged_user"),
    )
    events = events_of_file(F.col("tables"), F.col("raw_content"))
    no_event = F.get(F.filter(events, lambda e: F.lit(False)), F.lit(0))
    no_facts = F.when(F.lit(False), facts)
    rows = F.concat(
        F.array(F.struct(facts.alias("file"), no_event.alias("event"))),
        F.transform(events, lambda e: F.struct(no_facts.alias("file"), e.alias("event"))),
    )
    return audited.select(
        *by, "relative_path", "path", "engine_type", explode_found(rows).alias("r")
    ).select(*by, "relative_path", "path", "engine_type", "r.file", "r.event")


def audit_chains(
    files: DataFrame,
    by: Sequence[str],
    rules: Sequence[Rule] = SCHEMA_RULES,
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """The counters of every database: its files, and the replayed schema of a chain as one more file."""
    stored = materialise(files_and_events(files, by, rules, patterns))
    events = stored.filter(F.col("event").isNotNull()).select(*by, "event.*")
    of_files = stored.filter(F.col("file").isNotNull())
    facts = of_files.select(
        *by,
        "relative_path",
        "path",
        "engine_type",
        "file.has_cascade_text",
        "file.mentions_privileged_user",
        F.col("file.counts.secrets").alias("secrets"),
    )
    chains = materialise(chain_facts_of_files(facts, by))
    tables, columns = replay_events(events, by)
    found = findings_of_chains(chains, tables, columns, rules, by)
    counts = of_files.select(*by, "file.counts.*")
    return summary_of_counts(counts, chains, tables, found, rules, by)
