"""The texts that the comparison SQL expects, stated apart from the code that produces them."""

from __future__ import annotations

# Fixed values: (rule_ord, case_ord, rule id, title, framework, tier, description, remediation, reference);
# a text that the rule computes is empty.
SCHEMA_RULE_TEXTS = [
    (
        0,
        0,
        'FIN-DE-001',
        'Missing Debit/Credit Balance Constraint',
        'GAAP / IFRS Double-Entry Invariant Standard',
        'CRITICAL',
        (
            'Checks if a ledger/journal/transaction table lacks a CHECK constraint ensuring '
            'debits equal credits or balance invariants (amount != 0, balance >= 0, debit >= 0 '
            'AND credit >= 0).'
        ),
        (
            'Add database CHECK constraint or trigger enforcing debit/credit non-negative and '
            'zero-sum balance invariants.'
        ),
        'GAAP / IFRS Double-Entry Invariant Standard',
    ),
    (
        1,
        0,
        'FIN-DE-002',
        'Unsafe Cascade Delete on Ledger Tables',
        'GAAP / IFRS Double-Entry Invariant Standard',
        'CRITICAL',
        (
            'Checks for ON DELETE CASCADE or ON UPDATE CASCADE on ledger, transaction, payment, '
            'or wallet foreign key references.'
        ),
        (
            'Remove CASCADE delete/update on financial ledgers. Set ON DELETE RESTRICT or ON '
            'DELETE NO ACTION.'
        ),
        'GAAP / IFRS Double-Entry Invariant Standard & CBN Guidelines',
    ),
    (
        2,
        0,
        'FIN-PII-001',
        'Plaintext BVN/NIN Column Definition',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'CRITICAL',
        '',
        '',
        'NDPA 2023 S.29 (Database PII Encryption)',
    ),
    (
        3,
        0,
        'FIN-PII-002',
        'Plaintext Card PAN / CVV Column Definition',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'CRITICAL',
        '',
        '',
        'NDPA 2023 S.29 & PCI-DSS v4.0 Requirements',
    ),
    (
        4,
        0,
        'FIN-IMM-001',
        'Missing Immutability Triggers / Mutable Ledger',
        'CBN e-Payment Guidelines (PSPs/MMOs)',
        'CRITICAL',
        (
            'Checks if financial ledger tables (ledger, transaction, journal_entry, payment_log) '
            'lack triggers or policies preventing UPDATE or DELETE operations.'
        ),
        (
            'Implement BEFORE UPDATE OR DELETE triggers that raise exceptions to enforce '
            'append-only immutable ledgers.'
        ),
        'CBN e-Payment Guidelines (PSPs/MMOs)',
    ),
    (
        5,
        0,
        'FIN-IMM-002',
        'Missing Immutable Timestamps',
        'CBN Risk-Based Cybersecurity Framework',
        'HIGH',
        (
            'Checks if ledger tables lack created_at or timestamp default constraints (DEFAULT '
            'CURRENT_TIMESTAMP / DEFAULT NOW()).'
        ),
        'Add created_at timestamp column with DEFAULT CURRENT_TIMESTAMP constraint.',
        'CBN Risk-Based Cybersecurity Framework',
    ),
    (
        6,
        0,
        'FIN-CBN-001',
        'Missing Audit Trail Logging',
        'CBN e-Payment Guidelines (PSPs/MMOs)',
        'HIGH',
        (
            'Checks for missing audit log tables or CDC (Change Data Capture) configuration in '
            'database schema.'
        ),
        (
            'Configure dedicated audit_log table with trigger-based CDC for all balance '
            'mutations per CBN guidelines.'
        ),
        'CBN e-Payment Guidelines (PSPs/MMOs)',
    ),
    (
        7,
        0,
        'FIN-CBN-002',
        'Insecure Default DB User Permissions',
        'CBN Risk-Based Cybersecurity Framework',
        'MEDIUM',
        (
            'Checks for schema files executing as SUPERUSER or postgres / root application '
            'connections.'
        ),
        (
            'Grant principle of least privilege. Application user must not hold SUPERUSER or '
            'DROP TABLE privileges.'
        ),
        'CBN Risk-Based Cybersecurity Framework',
    ),
]
LINE_RULE_TEXTS = [
    (
        0,
        0,
        'CBN-001',
        'Hardcoded Credentials',
        'CBN Risk-Based Cybersecurity Framework',
        'CRITICAL',
        '',
        (
            'Move all credentials to a secrets manager (HashiCorp Vault, AWS Secrets Manager). '
            'Never hardcode credentials.'
        ),
        'CBN Risk-Based Cybersecurity Framework',
    ),
    (
        1,
        0,
        'CBN-002',
        'Permissive CORS Policy',
        'CBN Risk-Based Cybersecurity Framework',
        'HIGH',
        'Permissive CORS policy detected.',
        'Restrict CORS origins to known, trusted domains. Never use wildcard (*) in production.',
        'CBN Risk-Based Cybersecurity Framework',
    ),
    (
        2,
        0,
        'CBN-003',
        'Missing Log Retention',
        'CBN Risk-Based Cybersecurity Framework',
        'MEDIUM',
        '',
        (
            'Configure log retention for minimum 90 days per CBN guidelines. Implement '
            'centralized logging.'
        ),
        'CBN Risk-Based Cybersecurity Framework',
    ),
    (
        3,
        0,
        'CBN-004',
        'Debug Mode in Production',
        'CBN Risk-Based Cybersecurity Framework',
        'HIGH',
        'Debug mode enabled.',
        (
            'Disable debug mode in production. Set DEBUG=false and use production environment '
            'settings.'
        ),
        'CBN Risk-Based Cybersecurity Framework',
    ),
    (
        4,
        0,
        'CBN-005',
        'Missing Rate Limiting',
        'CBN Risk-Based Cybersecurity Framework',
        'MEDIUM',
        'Rate limiting appears to be disabled.',
        (
            'Implement API rate limiting. CBN guidelines require protection against brute-force '
            'and DDoS attacks.'
        ),
        'CBN Risk-Based Cybersecurity Framework',
    ),
    (
        5,
        0,
        'CBN-006',
        'Insecure Default Configurations',
        'CBN Risk-Based Cybersecurity Framework',
        'LOW',
        'Service bound to all interfaces (0.0.0.0).',
        (
            'Change default configurations. Restrict service binding and implement network-level '
            'access controls.'
        ),
        'CBN Risk-Based Cybersecurity Framework',
    ),
    (
        5,
        1,
        'CBN-006',
        'Insecure Default Configurations',
        'CBN Risk-Based Cybersecurity Framework',
        'LOW',
        'Default database port in use.',
        (
            'Change default configurations. Restrict service binding and implement network-level '
            'access controls.'
        ),
        'CBN Risk-Based Cybersecurity Framework',
    ),
    (
        6,
        0,
        'NDPA-001',
        'Transport Layer Encryption',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'CRITICAL',
        'Disabled SSL detected.',
        (
            'Enforce TLS/SSL on all database connections and API endpoints. Set sslmode=require '
            'or sslmode=verify-full.'
        ),
        'NDPA 2023 S.29',
    ),
    (
        6,
        1,
        'NDPA-001',
        'Transport Layer Encryption',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'CRITICAL',
        'HTTP URL detected. Use HTTPS.',
        (
            'Enforce TLS/SSL on all database connections and API endpoints. Set sslmode=require '
            'or sslmode=verify-full.'
        ),
        'NDPA 2023 S.29',
    ),
    (
        6,
        2,
        'NDPA-001',
        'Transport Layer Encryption',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'CRITICAL',
        'Database connection missing SSL requirement.',
        (
            'Enforce TLS/SSL on all database connections and API endpoints. Set sslmode=require '
            'or sslmode=verify-full.'
        ),
        'NDPA 2023 S.29',
    ),
    (
        7,
        0,
        'NDPA-002',
        'Data-at-Rest Encryption',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'HIGH',
        'Data-at-rest encryption explicitly disabled.',
        'Enable encryption at rest for all data stores. Use AES-256 or equivalent.',
        'NDPA 2023 S.29',
    ),
    (
        8,
        0,
        'NDPA-003',
        'PII Exposure in Static Config',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'CRITICAL',
        'PII (Email, BVN, NIN, or Name) detected.',
        'Remove all PII from configuration files. Use environment variables or secret managers.',
        'NDPA 2023 S.29',
    ),
    (
        9,
        0,
        'NDPA-004',
        'Data Retention Policy',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'MEDIUM',
        'Unlimited data retention detected.',
        (
            'Implement data retention policies with automatic purge. NDPA S.29 requires defined '
            'retention periods.'
        ),
        'NDPA 2023 S.29',
    ),
    (
        10,
        0,
        'NDPA-005',
        'Consent & Purpose Limitation',
        'NDPA 2023 S.29 (Database PII Encryption)',
        'MEDIUM',
        'Tracking/analytics configured without explicit consent.',
        'Implement consent management. NDPA requires explicit consent for data processing.',
        'NDPA 2023 S.29',
    ),
]

# The statements of each rule, with {t} for the table.
AUDIT_LOG_TEXT = """\
CREATE TABLE IF NOT EXISTS audit_log (
    id BIGSERIAL PRIMARY KEY,
    table_name VARCHAR(100) NOT NULL,
    operation VARCHAR(20) NOT NULL,
    record_id VARCHAR(100),
    old_data JSONB,
    new_data JSONB,
    performed_at TIMESTAMP WITH TIME ZONE DEFAULT CURRENT_TIMESTAMP
);"""
STATEMENT_TEXTS: dict[str, list[str]] = {
    'FIN-DE-001': [
        (
            'ALTER TABLE {t} ADD CONSTRAINT chk_{t}_balance_non_negative CHECK (debit >= 0 AND '
            'credit >= 0);\n'
        ),
    ],
    'FIN-DE-002': [
        (
            '-- WARNING: Remove ON DELETE CASCADE from {t} foreign keys.\n'
        ),
    ],
    'FIN-PII-001': [
        (
            'ALTER TABLE {t} ADD COLUMN bvn_encrypted BYTEA;\n'
        ),
    ],
    'FIN-PII-002': [
        (
            '-- Replace raw Card PAN/CVV on {t} with gateway tokens.\n'
        ),
    ],
    'FIN-IMM-001': [
        """\
CREATE OR REPLACE FUNCTION prevent_{t}_modification()
RETURNS TRIGGER AS $$
BEGIN
    RAISE EXCEPTION 'Financial ledger tables are immutable. UPDATE/DELETE operations prohibited.';
END;
$$ LANGUAGE plpgsql;
""",
        """\
CREATE TRIGGER trg_prevent_mod_{t}
BEFORE UPDATE OR DELETE ON {t}
FOR EACH ROW EXECUTE FUNCTION prevent_{t}_modification();
""",
    ],
    'FIN-IMM-002': [
        (
            'ALTER TABLE {t} ADD COLUMN IF NOT EXISTS created_at TIMESTAMP WITH TIME ZONE '
            'DEFAULT CURRENT_TIMESTAMP;\n'
        ),
    ],
    'FIN-CBN-001': [
        AUDIT_LOG_TEXT + "\n",
    ],
}
GUARD_TEXT = """\

CREATE OR REPLACE FUNCTION prevent_{t}_modification()
RETURNS TRIGGER AS $$
BEGIN
    RAISE EXCEPTION 'Financial ledger tables are immutable. UPDATE/DELETE prohibited.';
END;
$$ LANGUAGE plpgsql;

CREATE TRIGGER trg_prevent_mod_{t}
BEFORE UPDATE OR DELETE ON {t}
FOR EACH ROW EXECUTE FUNCTION prevent_{t}_modification();"""
