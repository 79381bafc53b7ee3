"""The default rules.

Ids, names, tiers, frameworks and texts are fixed values: they are the content of the findings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyguard.constants import (
    CATEGORY_LABELS,
    CREATED_COLUMNS,
    CYBERSECURITY,
    DATA_PROTECTION,
    DOUBLE_ENTRY,
    E_PAYMENT,
    MONEY_COLUMNS,
)
from tallyguard.functions.invariants import has_column, mentions
from tallyguard.functions.text import (
    DIGIT,
    SPACE,
    WORD_END,
    WORD_START,
    ascii_digits,
    contains_any,
)
from tallyguard.rules.model import COLUMN, FILE, HIT, LINE, TABLE, Rule, Scope

# --- schema rules ---------------------------------------------------------------------------


def _violates(classification: str):
    return lambda s: s.pii["is_violation"] & (s.pii["classification"] == classification)


SCHEMA_RULES: list[Rule] = [
    Rule(
        "FIN-DE-001",
        "Missing Debit/Credit Balance Constraint",
        DOUBLE_ENTRY,
        "CRITICAL",
        TABLE,
        lambda s: s.table["is_ledger_table"]
        & has_column(s.table["columns"], MONEY_COLUMNS)
        & ~mentions(s.table["constraints"], "check"),
        "Checks if a ledger/journal/transaction table lacks a CHECK constraint ensuring debits"
        " equal credits or balance invariants (amount != 0, balance >= 0, debit >= 0 AND"
        " credit >= 0).",
        "Add database CHECK constraint or trigger enforcing debit/credit non-negative and zero-sum"
        " balance invariants.",
        DOUBLE_ENTRY,
    ),
    Rule(
        "FIN-DE-002",
        "Unsafe Cascade Delete on Ledger Tables",
        DOUBLE_ENTRY,
        "CRITICAL",
        TABLE,
        lambda s: s.table["is_ledger_table"]
        & (s.file["has_cascade_text"] | mentions(s.table["constraints"], "cascade")),
        "Checks for ON DELETE CASCADE or ON UPDATE CASCADE on ledger, transaction, payment, or"
        " wallet foreign key references.",
        "Remove CASCADE delete/update on financial ledgers. Set ON DELETE RESTRICT or ON DELETE"
        " NO ACTION.",
        "GAAP / IFRS Double-Entry Invariant Standard & CBN Guidelines",
    ),
    Rule(
        "FIN-PII-001",
        "Plaintext BVN/NIN Column Definition",
        DATA_PROTECTION,
        "CRITICAL",
        COLUMN,
        _violates("UNENCRYPTED_BVN_NIN"),
        lambda s: s.pii["risk_reason"],
        lambda s: s.pii["remediation_hint"],
        DATA_PROTECTION,
    ),
    Rule(
        "FIN-PII-002",
        "Plaintext Card PAN / CVV Column Definition",
        DATA_PROTECTION,
        "CRITICAL",
        COLUMN,
        _violates("UNENCRYPTED_CARD_PAN"),
        lambda s: s.pii["risk_reason"],
        lambda s: s.pii["remediation_hint"],
        "NDPA 2023 S.29 & PCI-DSS v4.0 Requirements",
    ),
    Rule(
        "FIN-IMM-001",
        "Missing Immutability Triggers / Mutable Ledger",
        E_PAYMENT,
        "CRITICAL",
        TABLE,
        lambda s: s.table["is_ledger_table"] & ~mentions(s.table["triggers"], "update|delete"),
        "Checks if financial ledger tables (ledger, transaction, journal_entry, payment_log) lack"
        " triggers or policies preventing UPDATE or DELETE operations.",
        "Implement BEFORE UPDATE OR DELETE triggers that raise exceptions to enforce append-only"
        " immutable ledgers.",
        E_PAYMENT,
    ),
    Rule(
        "FIN-IMM-002",
        "Missing Immutable Timestamps",
        CYBERSECURITY,
        "HIGH",
        TABLE,
        lambda s: s.table["is_ledger_table"] & ~has_column(s.table["columns"], CREATED_COLUMNS),
        "Checks if ledger tables lack created_at or timestamp default constraints (DEFAULT"
        " CURRENT_TIMESTAMP / DEFAULT NOW()).",
        "Add created_at timestamp column with DEFAULT CURRENT_TIMESTAMP constraint.",
        CYBERSECURITY,
    ),
    Rule(
        "FIN-CBN-001",
        "Missing Audit Trail Logging",
        E_PAYMENT,
        "HIGH",
        FILE,
        lambda s: s.file["has_ledger_table"] & ~s.file["has_audit_table"],
        "Checks for missing audit log tables or CDC (Change Data Capture) configuration in"
        " database schema.",
        "Configure dedicated audit_log table with trigger-based CDC for all balance mutations per"
        " CBN guidelines.",
        E_PAYMENT,
    ),
    Rule(
        "FIN-CBN-002",
        "Insecure Default DB User Permissions",
        CYBERSECURITY,
        "MEDIUM",
        FILE,
        lambda s: s.file["mentions_privileged_user"],
        "Checks for schema files executing as SUPERUSER or postgres / root application"
        " connections.",
        "Grant principle of least privilege. Application user must not hold SUPERUSER or DROP"
        " TABLE privileges.",
        CYBERSECURITY,
    ),
]

# --- line rules -----------------------------------------------------------------------------

_NDPA = "NDPA 2023 S.29"


def _category_label(s: Scope) -> Column:
    label = F.lit(None).cast("string")
    for name, text in CATEGORY_LABELS.items():
        label = F.when(s.hit["category"] == name, F.lit(text)).otherwise(label)
    return F.coalesce(label, s.hit["category"])


def explicit_wildcard_origin(line: Column) -> Column:
    return contains_any(
        line["squeezed_lower"],
        [
            "access-control-allow-origin:*",
            "origin:'*'",
            'origin:"*"',
            "cors_origin_allow_all=true",
        ],
    )


def opens_cors_block(line: Column) -> Column:
    # The substrings leave out the letters that have look-alikes of another case.
    return contains_any(line["lower"], ["cor", "-allow-or", "allowed_or"]) & line["text"].rlike(
        "(?iu)cors|access-control-allow-origin|allowed_origins"
    )


def wildcard_in_block(line: Column) -> Column:
    """A wildcard that counts only inside of a CORS block."""
    return ~explicit_wildcard_origin(line) & contains_any(
        line["squeezed_lower"], ['"*"', "'*'", "origin:*"]
    )


def _retention_days(s: Scope) -> Column:
    """First number after the word retention, without leading zeros ('' when there is none)."""
    number = ascii_digits(
        F.regexp_extract(s.line["lower"], rf"retention.*?({DIGIT}+)", 1)
    )
    return F.when(number == "", F.lit("")).otherwise(
        F.regexp_replace(number, r"^0+(?=\d)", "")
    )


def _short_retention(s: Scope) -> Column:
    # at most two digits long before it is read as a number: longer ones are 100 or more
    return F.when(
        s.line["lower"].contains("retention"),
        _retention_days(s).rlike(r"^(?:\d|[0-8]\d)\z"),
    ).otherwise(F.lit(False))


def _is_database_line(s: Scope) -> Column:
    return (
        F.exists(s.line["hits"], lambda h: h["category"].contains("DATABASE"))
        | contains_any(
            s.line["lower"],
            ["[redacted:", "postgres", "mysql", "mongodb", "database_url", "db_url"],
        )
    )


_CORS = {
    "rule_id": "CBN-002",
    "name": "Permissive CORS Policy",
    "framework": CYBERSECURITY,
    "tier": "HIGH",
    "grain": LINE,
    "remediation": "Restrict CORS origins to known, trusted domains. Never use wildcard (*) in"
    " production.",
    "reference": CYBERSECURITY,
}

# The case that depends on earlier lines; it is evaluated by operators.cors.
CORS_BLOCK_CASE = Rule(
    **_CORS,
    when=lambda s: wildcard_in_block(s.line),
    description="Permissive CORS wildcard origin detected.",
)

_DEFAULTS = {
    "rule_id": "CBN-006",
    "name": "Insecure Default Configurations",
    "framework": CYBERSECURITY,
    "tier": "LOW",
    "grain": LINE,
    "remediation": "Change default configurations. Restrict service binding and implement"
    " network-level access controls.",
    "reference": CYBERSECURITY,
}


# Settings of default database ports, and of rate limits that are switched off.
DEFAULT_PORTS = ["port=3306", "port:3306", "port=5432", "port:5432", "port=27017", "port:27017"]
UNLIMITED_RATES = [
    "ratelimit=0", "ratelimit=false", "rate_limit=0", "rate_limit=false", "ratelimiting=false",
]


def _open_binding(s: Scope) -> Column:
    return contains_any(s.line["squeezed_lower"], ["bind_address=0.0.0.0", "bind=0.0.0.0"])


def _default_port(s: Scope) -> Column:
    return contains_any(s.line["squeezed_lower"], DEFAULT_PORTS)


CBN_RULES: list[Rule] = [
    Rule(
        "CBN-001",
        "Hardcoded Credentials",
        CYBERSECURITY,
        "CRITICAL",
        HIT,
        lambda s: F.lit(True),
        lambda s: F.concat(F.lit("Hardcoded credential detected: "), _category_label(s)),
        "Move all credentials to a secrets manager (HashiCorp Vault, AWS Secrets Manager). Never"
        " hardcode credentials.",
        CYBERSECURITY,
    ),
    Rule(
        **_CORS,
        when=lambda s: explicit_wildcard_origin(s.line),
        description="Permissive CORS policy detected.",
    ),
    Rule(
        "CBN-003",
        "Missing Log Retention",
        CYBERSECURITY,
        "MEDIUM",
        LINE,
        _short_retention,
        lambda s: F.concat(
            F.lit("Log retention is "),
            _retention_days(s),
            F.lit(" days, which is less than the required 90 days."),
        ),
        "Configure log retention for minimum 90 days per CBN guidelines. Implement centralized"
        " logging.",
        CYBERSECURITY,
    ),
    Rule(
        "CBN-004",
        "Debug Mode in Production",
        CYBERSECURITY,
        "HIGH",
        LINE,
        lambda s: contains_any(
            s.line["squeezed"],
            ["DEBUG=true", "NODE_ENV=development", "FLASK_DEBUG=1", "DJANGO_DEBUG=True"],
        )
        | s.line["squeezed_lower"].contains("debug:true"),
        "Debug mode enabled.",
        "Disable debug mode in production. Set DEBUG=false and use production environment"
        " settings.",
        CYBERSECURITY,
    ),
    Rule(
        "CBN-005",
        "Missing Rate Limiting",
        CYBERSECURITY,
        "MEDIUM",
        LINE,
        lambda s: contains_any(s.line["squeezed_lower"], UNLIMITED_RATES),
        "Rate limiting appears to be disabled.",
        "Implement API rate limiting. CBN guidelines require protection against brute-force and"
        " DDoS attacks.",
        CYBERSECURITY,
    ),
    Rule(
        **_DEFAULTS,
        when=_open_binding,
        description="Service bound to all interfaces (0.0.0.0).",
    ),
    Rule(
        **_DEFAULTS,
        when=lambda s: ~_open_binding(s) & _default_port(s),
        description="Default database port in use.",
    ),
]

_TRANSPORT = {
    "rule_id": "NDPA-001",
    "name": "Transport Layer Encryption",
    "framework": DATA_PROTECTION,
    "tier": "CRITICAL",
    "grain": LINE,
    "remediation": "Enforce TLS/SSL on all database connections and API endpoints. Set"
    " sslmode=require or sslmode=verify-full.",
    "reference": _NDPA,
}

# Names that mark seed data as personal.
PERSON_NAMES = ["chukwu", "ade", "okafor", "abubakar", "chioma", "sani"]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ELEVEN_DIGITS = rf"{WORD_START}{DIGIT}{{11}}{WORD_END}"

NDPA_RULES: list[Rule] = [
    Rule(
        **_TRANSPORT,
        when=lambda s: contains_any(s.line["lower"], ["ssl=false", "ssl=off"]),
        description="Disabled SSL detected.",
    ),
    Rule(
        **_TRANSPORT,
        when=lambda s: s.line["lower"].contains("http://")
        & ~contains_any(s.line["lower"], ["localhost", "127.0.0.1"]),
        description="HTTP URL detected. Use HTTPS.",
    ),
    Rule(
        **_TRANSPORT,
        when=lambda s: _is_database_line(s)
        & ~contains_any(s.line["lower"], ["sslmode=require", "sslmode=verify-full", "ssl=true"]),
        description="Database connection missing SSL requirement.",
    ),
    Rule(
        "NDPA-002",
        "Data-at-Rest Encryption",
        DATA_PROTECTION,
        "HIGH",
        LINE,
        lambda s: s.line["lower"].rlike(
            rf"(?:encrypt|encryption|encrypted){SPACE}*[:=]{SPACE}*(?:false|none|off)"
        ),
        "Data-at-rest encryption explicitly disabled.",
        "Enable encryption at rest for all data stores. Use AES-256 or equivalent.",
        _NDPA,
    ),
    Rule(
        "NDPA-003",
        "PII Exposure in Static Config",
        DATA_PROTECTION,
        "CRITICAL",
        LINE,
        lambda s: s.line["text"].rlike(rf"{EMAIL}|{ELEVEN_DIGITS}")
        | (
            contains_any(s.line["lower"], PERSON_NAMES)
            & F.lower(s.file["relative_path"]).rlike("seed|test")
        ),
        "PII (Email, BVN, NIN, or Name) detected.",
        "Remove all PII from configuration files. Use environment variables or secret managers.",
        _NDPA,
    ),
    Rule(
        "NDPA-004",
        "Data Retention Policy",
        DATA_PROTECTION,
        "MEDIUM",
        LINE,
        lambda s: contains_any(
            s.line["lower"], ["ttl=0", "retention=-1", "never_expire", "retention=unlimited"]
        ),
        "Unlimited data retention detected.",
        "Implement data retention policies with automatic purge. NDPA S.29 requires defined"
        " retention periods.",
        _NDPA,
    ),
    Rule(
        "NDPA-005",
        "Consent & Purpose Limitation",
        DATA_PROTECTION,
        "MEDIUM",
        LINE,
        lambda s: contains_any(s.line["lower"], ["analytics", "tracking"])
        & s.line["lower"].contains("consent=false"),
        "Tracking/analytics configured without explicit consent.",
        "Implement consent management. NDPA requires explicit consent for data processing.",
        _NDPA,
    ),
]

LINE_RULES: list[Rule] = CBN_RULES + NDPA_RULES
