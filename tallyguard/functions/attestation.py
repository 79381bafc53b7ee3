"""Texts and hashes of the attestation record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def target_fingerprint(root_path: Column, started_at: Column) -> Column:
    """First 16 hex digits of sha256 over ``path|iso time``."""
    return F.left(F.sha2(F.concat_ws("|", root_path, started_at), 256), F.lit(16))


def claim(rule_id: Column, passed: Column, framework: Column) -> Column:
    """``rule:<id>|passed:<True/False>|framework:<name>``."""
    return F.concat(
        F.lit("rule:"),
        rule_id,
        F.lit("|passed:"),
        F.when(passed, F.lit("True")).otherwise(F.lit("False")),
        F.lit("|framework:"),
        framework,
    )


def verifier_hash(salt: str, fingerprint: Column, root: Column, score: Column) -> Column:
    """sha256 over ``salt|fingerprint|root|score``; the score reads like 25.0."""
    return F.sha2(F.concat_ws("|", F.lit(salt), fingerprint, root, score.cast("string")), 256)


def signature(verifier: Column, completed_at: Column) -> Column:
    """First 64 hex digits of sha512 over ``verifier|iso time``."""
    return F.left(F.sha2(F.concat_ws("|", verifier, completed_at), 512), F.lit(64))
