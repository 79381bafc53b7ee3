"""Redaction of files, lines and any text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.redaction import (
    DEFAULT_PATTERNS,
    SecretPattern,
    may_contain_secret,
    redact_text,
)
from tallyguard.functions.text import explode_found
from tallyguard.functions.text import lines as split_lines

HIT_COLUMNS = [
    "line_number",
    "category",
    "original_snippet",
    "redacted_snippet",
    "pattern_name",
]


def redact(
    df: DataFrame, text_col: str, patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS
) -> DataFrame:
    """Adds ``redacted_text``, ``hits`` and ``secret_count`` for one text column.

    A projection: no shuffle, no Python, and texts without a secret are only searched once.
    """
    return (
        df.withColumn("_redacted", redact_text(F.col(text_col), patterns))
        .withColumn("redacted_text", F.col("_redacted.text"))
        .withColumn("hits", F.col("_redacted.hits"))
        .withColumn("secret_count", F.size("_redacted.hits"))
        .drop("_redacted")
    )


def redaction_hits(
    df: DataFrame,
    text_col: str,
    id_cols: Sequence[str],
    patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """One row per hit: the id columns, the line and what was found there."""
    return (
        df.filter(may_contain_secret(F.col(text_col), patterns))
        .select(
            *id_cols,
            explode_found(redact_text(F.col(text_col), patterns)["hits"]).alias("hit"),
        )
        .filter(F.col("hit").isNotNull())
        .select(*id_cols, *[F.col(f"hit.{c}") for c in HIT_COLUMNS])
    )


def explode_lines(files: DataFrame, text_col: str, id_cols: Sequence[str]) -> DataFrame:
    """(ids, line_number from 1, line) of a text column; terminators are removed."""
    return (
        files.select(
            *id_cols, F.posexplode_outer(split_lines(F.col(text_col))).alias("position", "line")
        )
        .filter(F.col("line").isNotNull())
        .select(*id_cols, (F.col("position") + 1).cast("bigint").alias("line_number"), "line")
    )
