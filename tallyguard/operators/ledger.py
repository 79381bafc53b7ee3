"""The double-entry invariant on rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def negative_entries(
    entries: DataFrame, debit_col: str = "debit", credit_col: str = "credit"
) -> DataFrame:
    """Rows that break ``debit >= 0 and credit >= 0``."""
    return entries.filter((F.col(debit_col) < 0) | (F.col(credit_col) < 0))


def unbalanced_groups(
    entries: DataFrame,
    keys: Sequence[str],
    debit_col: str = "debit",
    credit_col: str = "credit",
) -> DataFrame:
    """Groups whose debits and credits differ: keys, total_debit, total_credit.

    Sums are combined before the shuffle, so a group may have any size. Pass decimals: sums of
    doubles depend on the order of the rows.
    """
    return (
        entries.groupBy(*keys)
        .agg(F.sum(debit_col).alias("total_debit"), F.sum(credit_col).alias("total_credit"))
        .filter(
            F.coalesce("total_debit", F.lit(0)) != F.coalesce("total_credit", F.lit(0))
        )
    )
