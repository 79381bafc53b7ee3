"""Fixed values shared by the whole package.

Names, labels and word lists below are part of the results (they appear in outputs or decide
which rows appear), so they are spelled out as plain text.
"""

# --- fixed values: risk tiers and their weights -------------------------------------------
TIERS = [("CRITICAL", 4), ("HIGH", 3), ("MEDIUM", 2), ("LOW", 1)]

# --- fixed values: compliance frameworks ---------------------------------------------------
E_PAYMENT = "CBN e-Payment Guidelines (PSPs/MMOs)"
CYBERSECURITY = "CBN Risk-Based Cybersecurity Framework"
DATA_PROTECTION = "NDPA 2023 S.29 (Database PII Encryption)"
DOUBLE_ENTRY = "GAAP / IFRS Double-Entry Invariant Standard"
FRAMEWORKS = [E_PAYMENT, CYBERSECURITY, DATA_PROTECTION, DOUBLE_ENTRY]

# --- fixed values: redaction categories (name used in markers -> label used in texts) -------
CATEGORY_LABELS = {
    "DATABASE_URI": "Database Connection URI",
    "ENCRYPTION_KEY": "Database Encryption Key",
    "PLAINTEXT_BVN": "Plaintext BVN",
    "PLAINTEXT_NIN": "Plaintext NIN",
    "PLAINTEXT_PAN": "Plaintext Card PAN",
    "GENERIC_SECRET": "Generic Secret",
}

# --- fixed values: database engines --------------------------------------------------------
POSTGRESQL = "PostgreSQL"
MYSQL = "MySQL"
SQLITE = "SQLite"
PRISMA = "Prisma ORM"
GENERIC_SQL = "Generic SQL / Migration DDL"

# --- fixed values: corpus scan -------------------------------------------------------------
SCANNED_EXTENSIONS = ["sql", "prisma", "hcl", "tf", "py", "js", "ts", "json", "yaml", "yml"]
SKIPPED_DIRECTORIES = ["node_modules", "venv", ".venv", ".git", "dist", "build", "__pycache__"]
MAX_ARCHIVE_BYTES = 500 * 1024 * 1024

# --- fixed values: words that mark a table as a financial ledger ----------------------------
LEDGER_WORDS = [
    "ledger", "transaction", "balance", "entry", "journal", "payment",
    "payout", "wallet", "account_balance", "audit_log", "transfer", "settlement",
]

# --- fixed values: sensitive column names, secure types and suffixes ------------------------
IDENTITY_WORDS = ["bvn", "nin", "national_id", "bank_verification_number"]
CARD_WORDS = ["card_number", "card_pan", "pan", "cvv", "card_cvv"]
SECURE_TYPES = ["bytea", "blob", "varbinary", "binary"]
SECURE_SUFFIXES = [
    "_encrypted", "_hash", "_token", "_vault", "_enc", "_digest", "_masked", "_last4",
]
CARD_SAFE_SUFFIXES = ["_last4", "_token", "_masked"]

# --- fixed values: column names the table rules and invariants look at ----------------------
MONEY_COLUMNS = ["amount", "balance", "debit", "credit"]
CREATED_COLUMNS = ["created_at", "created"]
INVARIANT_COLUMNS = ["debit", "debit_amount", "credit", "credit_amount", "balance", "amount"]

# --- fixed values: names of the replayed schema --------------------------------------------
FINAL_SCHEMA_PATH = "reconstituted_final_schema.sql"
EMPTY_SCHEMA_PATH = "unified_schema.sql"
