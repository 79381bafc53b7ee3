"""Sensitive-column classification by name and type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyguard.constants import (
    CARD_SAFE_SUFFIXES,
    CARD_WORDS,
    IDENTITY_WORDS,
    SECURE_SUFFIXES,
    SECURE_TYPES,
)
from tallyguard.functions.text import contains_any


def _ends_with_any(text: Column, suffixes: list[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | text.endswith(suffix)
    return found


def _verdict(classification: str, violation: bool, reason: Column | str, hint: str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(
        F.lit(classification).alias("classification"),
        F.lit(violation).alias("is_violation"),
        reason.alias("risk_reason"),
        F.lit(hint).alias("remediation_hint"),
    )


def classify_column(name: Column, data_type: Column) -> Column:
    """struct<classification, is_violation, risk_reason, remediation_hint> for one column.

    Identity numbers win over card data. Identity numbers are safe behind a binary type or a
    protecting suffix, card data only behind a masking or token suffix.
    """
    lowered = F.lower(name)
    is_identity = contains_any(lowered, IDENTITY_WORDS)
    is_card = contains_any(lowered, CARD_WORDS)
    is_secured = contains_any(F.lower(data_type), SECURE_TYPES) | _ends_with_any(
        lowered, SECURE_SUFFIXES
    )
    is_masked_card = _ends_with_any(lowered, CARD_SAFE_SUFFIXES)

    # The reasons and hints are part of the findings.
    return (
        F.when(
            is_identity & is_secured,
            _verdict(
                "SECURE_ENCRYPTED_PII",
                False,
                "Column uses encrypted storage type or cryptographic token suffix.",
                "",
            ),
        )
        .when(
            is_identity,
            _verdict(
                "UNENCRYPTED_BVN_NIN",
                True,
                F.concat(
                    F.lit("Column '"),
                    name,
                    F.lit("' stores BVN/NIN in unencrypted plaintext type '"),
                    data_type,
                    F.lit("'."),
                ),
                "Encrypt BVN/NIN using column-level encryption (pgcrypto BYTEA) or HMAC-SHA256 hash.",
            ),
        )
        .when(
            is_card & is_masked_card,
            _verdict(
                "SECURE_TOKENIZED_CARD",
                False,
                "Column stores masked last4 digits or payment token.",
                "",
            ),
        )
        .when(
            is_card,
            _verdict(
                "UNENCRYPTED_CARD_PAN",
                True,
                F.concat(
                    F.lit("Column '"), name, F.lit("' stores raw Card PAN/CVV in plain text.")
                ),
                "Never store raw Card PAN or CVV. Use PCI-DSS compliant payment gateway tokenization.",
            ),
        )
        .otherwise(_verdict("NON_SENSITIVE", False, "Non-sensitive column.", ""))
    )
