"""File-level facts the schema rules ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIT_NAME = "audit|log"
_CASCADE = "on (?:delete|update) cascade"


def has_audit_table(tables: Column) -> Column:
    return F.exists(tables, lambda t: F.lower(t["name"]).rlike(AUDIT_NAME))


def has_ledger_table(tables: Column) -> Column:
    return F.exists(tables, lambda t: t["is_ledger_table"])


def mentions_privileged_user(raw: Column) -> Column:
    return F.lower(raw).rlike("superuser|postgres|root")


def has_cascade_text(raw: Column, redacted: Column) -> Column:
    """The phrase in the redacted text. Redaction cannot create it, so only texts that have it
    to begin with are looked at a second time."""
    return F.when(F.lower(raw).rlike(_CASCADE), F.lower(redacted).rlike(_CASCADE)).otherwise(
        F.lit(False)
    )
