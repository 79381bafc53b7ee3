"""Double-entry invariant of a table definition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_column(columns: Column, names: list[str]) -> Column:
    """True when the columns array holds one of the names exactly, ignoring case."""
    return F.exists(columns, lambda c: F.lower(c["name"]).isin(names))


def mentions(texts: Column, regex: str) -> Column:
    """True when a text of the array contains the (lower-case) regex, ignoring case."""
    return F.exists(texts, lambda t: F.lower(t).rlike(regex))


def table_invariant(columns: Column, constraints: Column) -> Column:
    """struct<is_sound, proof_expression, counter_example> of one table.

    A table is monetary when it has a debit and a credit column, or a balance or amount column;
    a monetary table is sound when a table-level constraint mentions a check.
    """
    monetary = (
        has_column(columns, ["debit", "debit_amount"])
        & has_column(columns, ["credit", "credit_amount"])
    ) | has_column(columns, ["balance", "amount"])
    checked = mentions(constraints, "check")

    def verdict(sound: bool, proof: str, example: str) -> Column:
        return F.struct(
            F.lit(sound).alias("is_sound"),
            F.lit(proof).alias("proof_expression"),
            F.lit(example).alias("counter_example"),
        )

    # The three verdict texts.
    return (
        F.when(
            ~monetary, verdict(True, "Non-ledger table. Invariant check skipped.", "")
        )
        .when(
            checked,
            verdict(
                True,
                "forall t in ledger: t.debit >= 0 && t.credit >= 0 && CHECK_PASSED(t)",
                "",
            ),
        )
        .otherwise(
            verdict(
                False,
                "!(debit >= 0 && credit >= 0 && SUM(debit) == SUM(credit))",
                "A negative balance transaction or unmatched debit can be inserted without"
                " database rejection.",
            )
        )
    )
