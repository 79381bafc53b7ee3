"""Comparison SQL for the registered queries.

Wherever a corpus is computed from keys, the expected rows are computed from the keys as well, not
by searching the text, so the comparison does not share the method of the query.
"""

from __future__ import annotations

from tallyguard.constants import CATEGORY_LABELS, CYBERSECURITY, FRAMEWORKS, TIERS
from tallyguard.plans.corpora import (
    CKEY,
    CONFIG_CORPUS,
    CONFIG_PATH,
    DDL_BODY,
    DDL_CONTENT,
    DDL_CREATE,
    DDL_DB,
    DDL_PATH,
    IS_PRISMA,
    K,
    KEY,
    LINE_KIND,
    MAIN_NAME,
    MIGRATION_FILES,
    MIGRATION_SQL,
    SEED_LINES,
    SEED_PATH,
    SEED_PLAIN,
    STATUS_TYPE,
    TRIGGER_TEXT,
)
from tallyguard.plans.expected_texts import (
    AUDIT_LOG_TEXT,
    GUARD_TEXT,
    LINE_RULE_TEXTS,
    SCHEMA_RULE_TEXTS,
    STATEMENT_TEXTS,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- redaction --------------------------------------------------------------------------------

_PATTERN_NAMES = {
    "GENERIC_SECRET": "Cloud API Keys & DB Passwords",
    "DATABASE_URI": "Database Connection URIs",
    "PLAINTEXT_BVN": "Plaintext BVN",
    "PLAINTEXT_NIN": "Plaintext NIN",
    "PLAINTEXT_PAN": "Plaintext Card PAN",
    "ENCRYPTION_KEY": "Database Encryption Keys",
}


def _seed_hits(columns: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {columns}, CAST({number} AS BIGINT) AS line_number, {_q(category)} AS category,
        concat(left({secret}, 4), '***') AS original_snippet,
        {_q(f'[REDACTED:{category}]')} AS redacted_snippet,
        {_q(_PATTERN_NAMES[category])} AS pattern_name
        FROM customer WHERE {cond}"""
        for number, (cond, _, secret, _, category) in SEED_LINES.items()
    )


_SEED_HITS = _seed_hits(f"{SEED_PATH} AS relative_path")
_SEED_REDACTED = "concat(" + ", ".join(
    f"CASE WHEN {cond} THEN concat({before}, {_q(f'[REDACTED:{category}]')}, {after})"
    f" ELSE {SEED_PLAIN.get(number, _q(''))} END, chr(10)"
    for number, (cond, before, _, after, category) in SEED_LINES.items()
) + ")"
_SEED_COUNT = " + ".join(
    f"CASE WHEN {cond} THEN 1 ELSE 0 END" for cond, *_ in SEED_LINES.values()
)

# the patterns as far as RE2 can express them on text of the documents table
_TEXT_STAGES = [
    (
        r"AKIA[0-9A-Z]{16}|sk_live_[a-zA-Z0-9]+|FLWSECK-[a-zA-Z0-9]+|MK_PROD_[a-zA-Z0-9]+"
        r"|sk-[a-zA-Z0-9]{20,}",
        "GENERIC_SECRET",
    ),
    (r"(?:postgres|mysql|mongodb|redis)://\S+", "DATABASE_URI"),
    (r"""['"]2\d{10}['"]""", "PLAINTEXT_BVN"),
    (r"""['"]1\d{10}['"]""", "PLAINTEXT_NIN"),
    (r"""['"]4\d{15}['"]""", "PLAINTEXT_PAN"),
]
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _redacted(text: str) -> str:
    for regex, category in _TEXT_STAGES:
        text = f"regexp_replace({text}, {_q(regex)}, {_q(f'[REDACTED:{category}]')}, 'g')"
    return text


_TEXT_HITS = " + ".join(
    f"len(regexp_extract_all(text, {_q(regex)}))" for regex, _ in _TEXT_STAGES
)
_LINE_COUNT = f"len(regexp_split_to_array(text, {_q(_BREAKS)}))"
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

_SPLIT_LINES = f"""regexp_split_to_array(
  CASE WHEN regexp_matches(text, {_q(f'(?:{_BREAKS})$')})
       THEN regexp_replace(text, {_q(f'(?:{_BREAKS})$')}, '') ELSE text END, {_q(_BREAKS)})"""


# --- DDL corpus ---------------------------------------------------------------------------------

_DDL = f"""
keys AS (
  SELECT {K} AS k, {IS_PRISMA} AS is_prisma, {DDL_DB} AS db, {DDL_PATH} AS relative_path,
         {MAIN_NAME} AS main_name, * FROM orders),
tabs AS (
  SELECT k, db, relative_path, is_prisma, 0 AS table_ord, main_name AS name,
         k % 5 IN (0, 2, 4) AS is_ledger, true AS has_money, k % 4 = 0 AS has_check,
         k % 4 IN (0, 1) AS has_constraint, k % 3 = 0 AS cascades, k % 10 = 0 AS guarded,
         k % 5 = 0 AS has_trigger, k % 2 = 0 AS has_created
  FROM keys WHERE NOT is_prisma
  UNION ALL
  SELECT k, db, relative_path, is_prisma, 1, concat('audit_log_', CAST(k AS STRING)),
         true, false, false, false, k % 3 = 0, false, false, false
  FROM keys WHERE NOT is_prisma AND k % 9 = 0
  UNION ALL
  SELECT k, db, relative_path, is_prisma, 0, concat('Wallet', CAST(k AS STRING)),
         true, false, false, false, false, false, false, false
  FROM keys WHERE is_prisma),
listed AS (
  SELECT t.*, c.* FROM tabs t, LATERAL (VALUES
    (1, NOT is_prisma, 'id', 'BIGINT', true, true, false, ''),
    (1, is_prisma, 'id', 'Int', false, true, false, ''),
    (2, NOT is_prisma AND table_ord = 0, 'owner_id', 'INT', true, false, true, 'owners'),
    (2, is_prisma, 'pan', 'String', k % 2 = 0, false, false, ''),
    (2, NOT is_prisma AND table_ord = 1, 'note', 'TEXT', true, false, false, ''),
    (3, is_prisma, 'owner', 'User', false, false, true, 'id'),
    (3, NOT is_prisma AND table_ord = 0, 'amount', 'DECIMAL(15,2)', false, false, false, ''),
    (4, NOT is_prisma AND table_ord = 0 AND k % 7 = 0, 'bvn', 'VARCHAR(11)', true, false, false, ''),
    (4, NOT is_prisma AND table_ord = 0 AND k % 7 = 1, 'nin', 'CHAR(11)', true, false, false, ''),
    (4, NOT is_prisma AND table_ord = 0 AND k % 7 = 2, 'bvn_encrypted', 'BYTEA', true, false, false, ''),
    (5, NOT is_prisma AND table_ord = 0 AND k % 11 = 0, 'card_pan', 'VARCHAR(16)', true, false, false, ''),
    (5, NOT is_prisma AND table_ord = 0 AND k % 11 = 1, 'card_pan_last4', 'CHAR(4)', true, false, false, ''),
    (6, NOT is_prisma AND table_ord = 0 AND k % 2 = 0, 'created_at', 'TIMESTAMP', true, false, false, ''),
    (7, NOT is_prisma AND table_ord = 0, 'status', '{STATUS_TYPE}', true, false, false, '')
  ) AS c(place, present, col_name, data_type, is_nullable, is_primary_key, is_foreign_key, refs)),
cols AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY k, table_ord ORDER BY place) - 1 AS INT) AS col_ord,
    CASE WHEN col_name IN ('bvn', 'nin') THEN 'UNENCRYPTED_BVN_NIN'
         WHEN col_name = 'bvn_encrypted' THEN 'SECURE_ENCRYPTED_PII'
         WHEN col_name = 'card_pan_last4' THEN 'SECURE_TOKENIZED_CARD'
         WHEN col_name IN ('card_pan', 'pan') THEN 'UNENCRYPTED_CARD_PAN'
         ELSE 'NON_SENSITIVE' END AS classification
  FROM listed WHERE present),
pii AS (
  SELECT *, classification LIKE 'UNENCRYPTED%' AS is_violation,
    CASE classification
      WHEN 'UNENCRYPTED_BVN_NIN' THEN concat('Column ''', col_name, ''' stores BVN/NIN in unencrypted plaintext type ''', data_type, '''.')
      WHEN 'UNENCRYPTED_CARD_PAN' THEN concat('Column ''', col_name, ''' stores raw Card PAN/CVV in plain text.')
      WHEN 'SECURE_ENCRYPTED_PII' THEN 'Column uses encrypted storage type or cryptographic token suffix.'
      WHEN 'SECURE_TOKENIZED_CARD' THEN 'Column stores masked last4 digits or payment token.'
      ELSE 'Non-sensitive column.' END AS risk_reason,
    CASE classification
      WHEN 'UNENCRYPTED_BVN_NIN' THEN 'Encrypt BVN/NIN using column-level encryption (pgcrypto BYTEA) or HMAC-SHA256 hash.'
      WHEN 'UNENCRYPTED_CARD_PAN' THEN 'Never store raw Card PAN or CVV. Use PCI-DSS compliant payment gateway tokenization.'
      ELSE '' END AS remediation_hint
  FROM cols)"""


def _rule_rows(texts: list[tuple]) -> str:
    rows = ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else _q(v) for v in row) + ")" for row in texts
    )
    return (
        f"(VALUES {rows}) AS r(rule_ord, case_ord, rule_id, title, framework, risk_tier, description,"
        " remediation, reference)"
    )


_FOUND = f"""
places AS (
  SELECT 'FIN-DE-001' AS rule_id, k, db, relative_path, table_ord, -1 AS col_ord, name AS table_name,
         '' AS column_name, '' AS reason, '' AS hint
  FROM tabs WHERE is_ledger AND has_money AND NOT has_check
  UNION ALL SELECT 'FIN-DE-002', k, db, relative_path, table_ord, -1, name, '', '', ''
  FROM tabs WHERE is_ledger AND cascades
  UNION ALL SELECT 'FIN-PII-001', k, db, relative_path, table_ord, col_ord, name, col_name, risk_reason, remediation_hint
  FROM pii WHERE classification = 'UNENCRYPTED_BVN_NIN'
  UNION ALL SELECT 'FIN-PII-002', k, db, relative_path, table_ord, col_ord, name, col_name, risk_reason, remediation_hint
  FROM pii WHERE classification = 'UNENCRYPTED_CARD_PAN'
  UNION ALL SELECT 'FIN-IMM-001', k, db, relative_path, table_ord, -1, name, '', '', ''
  FROM tabs WHERE is_ledger AND NOT guarded
  UNION ALL SELECT 'FIN-IMM-002', k, db, relative_path, table_ord, -1, name, '', '', ''
  FROM tabs WHERE is_ledger AND NOT has_created
  UNION ALL SELECT 'FIN-CBN-001', k, db, relative_path, -1, -1, '', '', '', ''
  FROM keys WHERE is_prisma OR (k % 5 IN (0, 2, 4) AND k % 9 <> 0)
  UNION ALL SELECT 'FIN-CBN-002', k, db, relative_path, -1, -1, '', '', '', ''
  FROM keys WHERE is_prisma OR k % 4 = 0),
found AS (
  SELECT r.rule_ord, p.relative_path, p.table_ord, p.col_ord, r.rule_id, r.title,
    CASE WHEN p.reason <> '' THEN p.reason ELSE r.description END AS description,
    r.framework, r.risk_tier, p.relative_path AS file_path, p.table_name, p.column_name,
    '' AS code_snippet,
    CASE WHEN p.hint <> '' THEN p.hint ELSE r.remediation END AS remediation, r.reference,
    p.db, p.k
  FROM places p JOIN {_rule_rows(SCHEMA_RULE_TEXTS)} ON p.rule_id = r.rule_id)"""
_WITH_DDL = f"WITH {_DDL} "
_WITH_FOUND = f"WITH {_DDL}, {_FOUND} "
_TABLE_OR_NA = "CASE WHEN table_name = '' THEN 'N/A' ELSE table_name END"
_TIER_ROWS = ", ".join(f"({_q(t)}, {w})" for t, w in TIERS)


def _results(rules, source: str) -> str:
    return f"""SELECT r.rule_ord, r.rule_id, r.title AS rule_name, r.framework,
      count(f.rule_id) = 0 AS passed, count(f.rule_id) AS finding_count
      FROM {_rule_rows(rules)} LEFT JOIN {source} f ON r.rule_id = f.rule_id
      WHERE r.case_ord = 0 GROUP BY ALL"""


def _totals(by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    tiers = ", ".join(
        f"CAST(count(*) FILTER (risk_tier = {_q(t)}) AS BIGINT) AS {t.lower()}_findings"
        for t, _ in TIERS
    )
    columns = ", ".join(f"coalesce({t.lower()}_findings, 0) AS {t.lower()}_findings" for t, _ in TIERS)
    return f"""{_WITH_FOUND}, f AS (SELECT {key} count(*) AS total_files_scanned FROM keys {group}),
      t AS (SELECT {key} count(*) AS total_tables_audited,
                   count(*) FILTER (is_ledger) AS total_ledger_tables_found FROM tabs {group}),
      n AS (SELECT {key} count(*) AS total_findings, count(DISTINCT rule_id) AS failed, {tiers}
            FROM found {group})
      SELECT {key} total_files_scanned, total_tables_audited, total_ledger_tables_found,
        CAST(0 AS BIGINT) AS total_secrets_redacted, coalesce(total_findings, 0) AS total_findings,
        {columns},
        CASE WHEN critical_findings > 0 THEN 'CRITICAL' WHEN high_findings > 0 THEN 'HIGH'
             WHEN medium_findings > 0 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk_tier,
        round((8 - coalesce(failed, 0)) * 100.0 / 8, 1)::DOUBLE AS compliance_score
      FROM f LEFT JOIN t {join} LEFT JOIN n {join}"""


def _fill(template: str, table: str) -> str:
    return "concat(" + f", {table}, ".join(_q(piece) for piece in template.split("{t}")) + ")"


_STATEMENT_ROWS = " UNION ALL ".join(
    [
        "SELECT *, 0 AS stmt_ord, concat('-- [', rule_id, '] ', title) AS statement FROM found",
        f"SELECT *, 1, concat('-- Risk: ', risk_tier, ' | Table: ', {_TABLE_OR_NA}) FROM found",
    ]
    + [
        f"SELECT *, {2 + i}, {_fill(template, 'named')} FROM found WHERE rule_id = {_q(rule_id)}"
        for rule_id, templates in STATEMENT_TEXTS.items()
        for i, template in enumerate(templates)
    ]
)

# Tables whose CREATE TABLE can be found by plain name: no IF NOT EXISTS, no quotes.
_BROKEN = """broken AS (
  SELECT k, db, relative_path, table_ord, table_name, bool_or(rule_id = 'FIN-PII-001') AS pii,
         bool_or(rule_id = 'FIN-IMM-002') AS imm, bool_or(rule_id = 'FIN-DE-001') AS de
  FROM found WHERE table_name <> '' GROUP BY ALL),
patched AS (
  SELECT b.*, CASE WHEN table_ord = 1 THEN 'id BIGINT PRIMARY KEY, note TEXT' ELSE """ + DDL_BODY + """ END AS body
  FROM broken b JOIN keys USING (k)
  WHERE NOT keys.is_prisma AND (table_ord = 1 OR (b.k % 8 <> 0 AND b.k % 6 NOT IN (1, 2)))),
rewritten AS (
  SELECT db, relative_path, k, table_ord, table_name, body, concat('CREATE TABLE ', table_name, ' (',
    CASE WHEN pii THEN replace(body, 'bvn VARCHAR(11)', 'bvn_encrypted BYTEA') ELSE body END,
    CASE WHEN imm THEN concat(',', chr(10), '    created_at TIMESTAMP WITH TIME ZONE DEFAULT CURRENT_TIMESTAMP') ELSE '' END,
    CASE WHEN de THEN concat(',', chr(10), '    CONSTRAINT chk_', table_name, '_balance CHECK (debit >= 0 AND credit >= 0)') ELSE '' END,
    chr(10), ');') AS patched_ddl
  FROM patched)"""

# --- config corpus ------------------------------------------------------------------------------

_KINDS = f"SELECT event_id, user_id, {LINE_KIND} AS kind, {CONFIG_PATH} AS relative_path, event_id + 1 AS line_number FROM events"
# (rule id, case, condition on kind)
_CONFIG_CASES = [
    ("CBN-001", 0, "kind IN (21, 22)"),
    ("CBN-002", 0, "kind = 3"),
    ("CBN-003", 0, "kind = 6 AND event_id % 200 < 90"),
    ("CBN-004", 0, "kind IN (4, 5)"),
    ("CBN-005", 0, "kind = 7"),
    ("CBN-006", 0, "kind = 8"),
    ("CBN-006", 1, "kind = 9"),
    ("NDPA-001", 0, "kind = 10"),
    ("NDPA-001", 1, "kind = 11"),
    ("NDPA-001", 2, "kind IN (13, 21, 22)"),
    ("NDPA-002", 0, "kind = 15"),
    ("NDPA-003", 0, "kind IN (16, 17) OR (kind = 20 AND relative_path LIKE '%test%')"),
    ("NDPA-004", 0, "kind = 18"),
    ("NDPA-005", 0, "kind = 19"),
]
_CORS = f"""marked AS (SELECT *, kind IN (0, 3) AS opens, kind IN (1, 2) AS wild FROM ({_KINDS})),
state AS (
  SELECT *,
    max(CASE WHEN opens THEN line_number END) OVER
      (PARTITION BY relative_path ORDER BY line_number) AS last_open,
    max(CASE WHEN wild THEN line_number END) OVER
      (PARTITION BY relative_path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_wild
  FROM marked),
block AS (
  SELECT relative_path, line_number, 'Permissive CORS wildcard origin detected.' AS description
  FROM state WHERE wild AND last_open IS NOT NULL AND (last_wild IS NULL OR last_wild < last_open))"""
_CONFIG = f"""WITH {_CORS},
hits AS ({" UNION ALL ".join(
    f"SELECT {_q(rule)} AS rule_id, {case} AS case_ord, event_id, kind, relative_path, line_number FROM ({_KINDS}) WHERE {cond}"
    for rule, case, cond in _CONFIG_CASES)}),
config AS (
  SELECT r.rule_ord, r.rule_id, h.relative_path, h.line_number, h.case_ord AS sub_ord, r.title,
    CASE WHEN h.rule_id = 'CBN-001' AND kind = 21 THEN 'Hardcoded credential detected: Generic Secret'
         WHEN h.rule_id = 'CBN-001' THEN 'Hardcoded credential detected: Database Connection URI'
         WHEN h.rule_id = 'CBN-003' THEN concat('Log retention is ', CAST(event_id % 200 AS STRING), ' days, which is less than the required 90 days.')
         ELSE r.description END AS description,
    r.framework, r.risk_tier, r.remediation, r.reference
  FROM hits h JOIN {_rule_rows(LINE_RULE_TEXTS)} ON h.rule_id = r.rule_id AND h.case_ord = r.case_ord
  UNION ALL
  SELECT r.rule_ord, r.rule_id, b.relative_path, b.line_number, 1, r.title, b.description,
    r.framework, r.risk_tier, r.remediation, r.reference
  FROM block b JOIN {_rule_rows(LINE_RULE_TEXTS)} ON r.rule_id = 'CBN-002' AND r.case_ord = 0)"""

# --- migration corpus -----------------------------------------------------------------------------

_DIR = "concat('m', lpad(CAST(k AS STRING), 12, '0'), '/')"
_MDB = "CASE WHEN k % 3 = 0 THEN 'db_main' ELSE concat('db_', CAST(k AS STRING)) END"
_ITEM_FILE = MIGRATION_FILES[2].columns["relative_path"]
_MIGRATION = f"""
base AS (SELECT o_orderkey AS k FROM orders),
steps AS (SELECT l_orderkey AS k, {_ITEM_FILE} AS path, l_partkey, l_suppkey FROM lineitem),
resets AS (
  SELECT k, concat({_DIR}, CASE WHEN k % 5 = 0 THEN '0003_reset.sql' ELSE '0000_init.sql' END) AS reset_path
  FROM base),
defines AS (
  SELECT k, reset_path AS path, 0 AS phase, c.pos, c.name, c.data_type, c.is_nullable, c.is_pk
  FROM resets, LATERAL (VALUES
    (0, true, 'id', 'BIGINT', true, true),
    (1, true, 'amount', 'DECIMAL(10,2)', false, false),
    (2, true, 'status', 'TEXT', true, false),
    (3, k % 5 = 0, 'c1', 'INT', true, false),
    (4, k % 5 = 0, 'created_at', 'DATE', true, false)) AS c(pos, present, name, data_type, is_nullable, is_pk)
  WHERE c.present
  UNION ALL
  SELECT k, path, 1, 0, concat('c', CAST(l_partkey % 6 AS STRING)),
         concat('VARCHAR(', CAST(l_suppkey % 20 AS STRING), ')'), true, false
  FROM steps WHERE l_partkey % 4 < 2
  UNION ALL
  SELECT k, path, 1, 0, 'Note', 'INT', true, false FROM steps WHERE l_partkey % 4 = 3),
drops AS (
  SELECT k, path, concat('c', CAST(l_partkey % 6 AS STRING)) AS name FROM steps WHERE l_partkey % 4 = 2
  UNION ALL SELECT k, path, 'status' FROM steps WHERE l_partkey % 4 = 3),
last_drop AS (SELECT k, lower(name) AS col, max(path) AS drop_path FROM drops GROUP BY 1, 2),
live AS (
  SELECT d.*, lower(d.name) AS col FROM defines d JOIN resets r USING (k)
  LEFT JOIN last_drop x ON x.k = d.k AND x.col = lower(d.name)
  WHERE d.path >= r.reset_path AND (x.drop_path IS NULL OR d.path > x.drop_path)),
kept AS (
  SELECT k, col, min((path, phase, pos)) AS first_at,
    arg_min(name, (path, phase, pos)) AS name, arg_max(data_type, (path, phase, pos)) AS data_type,
    arg_min(is_nullable, (path, phase, pos)) AS is_nullable, arg_min(is_pk, (path, phase, pos)) AS is_primary_key
  FROM live GROUP BY k, col),
chains AS (
  SELECT db, count(*) AS file_count, min(relative_path) AS path FROM ({MIGRATION_SQL}) GROUP BY db HAVING count(*) > 1)"""

_TABLES = {
    "redact_hits": _SEED_HITS,
    "redact_files": f"SELECT {SEED_PATH} AS relative_path, {_SEED_REDACTED} AS redacted_text,"
    f" CAST({_SEED_COUNT} AS INT) AS secret_count FROM customer",
    "secrets_per_category": f"""SELECT nation, category, count(*) AS secrets,
        count(DISTINCT relative_path) AS files
        FROM ({_seed_hits(f"c_nationkey AS nation, {SEED_PATH} AS relative_path")}) GROUP BY 1, 2""",
    "redact_documents": f"""SELECT doc_id, concat({_redacted('text')}, chr(10),
        'aws_key=[REDACTED:GENERIC_SECRET] and again [REDACTED:GENERIC_SECRET]', chr(10),
        'url=[REDACTED:DATABASE_URI]') AS redacted_text,
        CAST({_TEXT_HITS} + 3 AS INT) AS secret_count FROM documents""",
    "document_hits": f"""WITH lines AS (
        SELECT doc_id, {_SPLIT_LINES} AS parts FROM documents),
      numbered AS (SELECT doc_id, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS line_number FROM lines),
      own AS ({" UNION ALL ".join(
          f"SELECT doc_id, line_number, {_q(category)} AS category, unnest(regexp_extract_all(text, {_q(regex)})) AS found FROM numbered"
          for regex, category in _TEXT_STAGES)}),
      added AS (
        SELECT doc_id, {_LINE_COUNT} + c.step AS line_number, c.category, c.found
        FROM documents, LATERAL (VALUES
          (1, 'GENERIC_SECRET', 'AKIA'), (1, 'GENERIC_SECRET', 'AKIA'), (2, 'DATABASE_URI', 'mysql'))
          AS c(step, category, found)),
      names AS (SELECT * FROM (VALUES {", ".join(f"({_q(c)}, {_q(n)})" for c, n in _PATTERN_NAMES.items())}) AS v(category, pattern_name))
      SELECT doc_id, line_number, category, concat(left(found, 4), '***') AS original_snippet,
        concat('[REDACTED:', category, ']') AS redacted_snippet, pattern_name
      FROM (SELECT * FROM own UNION ALL SELECT * FROM added) JOIN names USING (category)""",
    "redact_emails": f"""SELECT doc_id,
        regexp_replace(text, {_q(_EMAIL)}, '[REDACTED:EMAIL]', 'g') AS redacted_text,
        CAST(len(regexp_extract_all(text, {_q(_EMAIL)})) AS INT) AS secret_count
        FROM documents WHERE regexp_matches(text, {_q(_EMAIL)})""",
    "document_lines": f"""WITH parts AS (SELECT doc_id, {_SPLIT_LINES} AS parts FROM documents)
        SELECT doc_id, len(parts) AS last_line,
          CAST(list_sum(list_transform(parts, lambda p: length(p))) AS BIGINT) AS characters
        FROM parts""",
    "config_findings": _CONFIG + " SELECT * FROM config",
    "cors_findings": f"WITH {_CORS} SELECT * FROM block",
    "config_rule_results": _CONFIG + _results(LINE_RULE_TEXTS, "config"),
    "seed_credentials": f"""SELECT relative_path, line_number,
        concat('Hardcoded credential detected: ', CASE category {" ".join(f"WHEN {_q(c)} THEN {_q(v)}" for c, v in CATEGORY_LABELS.items())} END) AS description
        FROM ({_SEED_HITS})""",
    "pii_lines": f"""WITH texts AS (
        SELECT concat('documents/', CAST(doc_id AS STRING)) AS relative_path, text FROM documents
        UNION ALL
        SELECT concat('conversations/', CAST(conv_id AS STRING), '/', CAST(turn AS STRING)), text FROM conversations),
      split AS (SELECT relative_path, {_SPLIT_LINES} AS parts FROM texts),
      lines AS (SELECT relative_path, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_number FROM split)
      SELECT 'NDPA-003' AS rule_id, relative_path, line_number FROM lines
      WHERE regexp_matches(line, {_q(_EMAIL)})
         OR regexp_matches(line, '(?:^|[^\\p{{L}}\\p{{N}}_])\\p{{Nd}}{{11}}(?:[^\\p{{L}}\\p{{N}}_]|$)')""",
    "insecure_urls": """SELECT concat('pages/', CAST(page_id AS STRING)) AS relative_path,
        'HTTP URL detected. Use HTTPS.' AS description FROM pages
        WHERE contains(lower(url), 'http://') AND NOT contains(lower(url), 'localhost')
          AND NOT contains(url, '127.0.0.1')""",
    "scan_scope": """SELECT CASE page_id % 10 WHEN 0 THEN concat('a/', CAST(page_id AS STRING), '.sql')
          WHEN 3 THEN concat('x/y/', CAST(page_id AS STRING), '.SQL')
          WHEN 7 THEN concat('conf/', CAST(page_id AS STRING), '.Yaml')
          ELSE concat('mybuild/', CAST(page_id AS STRING), '.tf') END AS relative_path,
        CASE WHEN contains(lower(html), 'postgres') THEN 'PostgreSQL'
          WHEN contains(lower(html), 'mysql') THEN 'MySQL'
          WHEN contains(lower(html), 'sqlite') THEN 'SQLite'
          ELSE 'Generic SQL / Migration DDL' END AS engine_type,
        md5(CASE WHEN page_id % 10 = 7 THEN replace(html, ' ', chr(10)) ELSE html END) AS content_md5
        FROM pages WHERE page_id % 10 IN (0, 3, 7, 8)""",
    "scan_files": """SELECT CASE page_id % 8 WHEN 0 THEN concat('a/_', CAST(page_id AS STRING), '.sql')
          WHEN 1 THEN concat('.', CAST(page_id AS STRING), '.json')
          WHEN 3 THEN concat('_x/.y/', CAST(page_id AS STRING), '.YML')
          WHEN 5 THEN concat('plain/', CAST(page_id AS STRING), '.ts')
          ELSE concat('empty/_', CAST(page_id AS STRING), '.tf') END AS relative_path,
        CASE WHEN page_id % 8 = 7 THEN 'Generic SQL / Migration DDL'
          WHEN contains(lower(html), 'postgres') THEN 'PostgreSQL'
          WHEN contains(lower(html), 'mysql') THEN 'MySQL'
          WHEN contains(lower(html), 'sqlite') THEN 'SQLite'
          ELSE 'Generic SQL / Migration DDL' END AS engine_type,
        md5(CASE WHEN page_id % 8 = 7 THEN '' ELSE html END) AS content_md5
        FROM pages WHERE page_id % 8 IN (0, 1, 3, 5, 7)""",
    "scan_rejects": """WITH sized AS (
          SELECT page_id, strlen(html) + CASE WHEN page_id % 8 = 4 THEN 2 ELSE 0 END AS bytes FROM pages)
        SELECT CASE page_id % 8 WHEN 0 THEN concat('a/_', CAST(page_id AS STRING), '.sql')
          WHEN 1 THEN concat('.', CAST(page_id AS STRING), '.json')
          WHEN 3 THEN concat('_x/.y/', CAST(page_id AS STRING), '.YML')
          WHEN 4 THEN concat('bad/.', CAST(page_id AS STRING), '.sql')
          ELSE concat('plain/', CAST(page_id AS STRING), '.ts') END AS relative_path,
        CASE WHEN bytes > 3000 THEN 'larger than 3000 bytes' ELSE 'not valid UTF-8' END AS reason
        FROM sized WHERE page_id % 8 = 4 OR (page_id % 8 IN (0, 1, 3, 5) AND bytes > 3000)""",
    "range_lines": f"""WITH parts AS (SELECT doc_id, {_SPLIT_LINES} AS parts FROM documents WHERE text <> '')
        SELECT concat('docs/_', CAST(doc_id AS STRING), '.yaml') AS relative_path, len(parts) AS last_line,
          len(parts) AS lines, CAST(list_sum(list_transform(parts, lambda p: length(p))) AS BIGINT) AS characters
        FROM parts""",
    "range_findings": f"""WITH split AS (SELECT doc_id, {_SPLIT_LINES} AS parts FROM documents),
      lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_number FROM split)
      SELECT 'NDPA-003' AS rule_id, concat('docs/_', CAST(doc_id AS STRING), '.yaml') AS relative_path, line_number
      FROM lines WHERE regexp_matches(line, {_q(_EMAIL)})
         OR regexp_matches(line, '(?:^|[^\\p{{L}}\\p{{N}}_])\\p{{Nd}}{{11}}(?:[^\\p{{L}}\\p{{N}}_]|$)')""",
    "engine_types": f"""SELECT CASE WHEN {IS_PRISMA} THEN 'Prisma ORM' WHEN {K} % 4 = 0 THEN 'PostgreSQL'
          WHEN {K} % 4 = 1 THEN 'MySQL' WHEN {K} % 4 = 2 THEN 'SQLite'
          ELSE 'Generic SQL / Migration DDL' END AS engine_type, count(*) AS files
        FROM orders GROUP BY 1""",
    "ddl_tables": _WITH_DDL
    + """SELECT relative_path, table_ord, name, is_ledger AS is_ledger_table,
        CAST(count(col_name) AS INT) AS column_count,
        CAST(any_value(has_constraint)::INT AS INT) AS constraint_count,
        CAST(any_value(has_trigger)::INT AS INT) AS trigger_count
        FROM cols GROUP BY relative_path, table_ord, name, is_ledger""",
    "fallback_tables": _WITH_DDL
    + """SELECT relative_path, table_ord, name, CAST(count(col_name) AS INT) AS column_count
        FROM cols GROUP BY relative_path, table_ord, name""",
    "ddl_columns": _WITH_DDL
    + """SELECT relative_path, table_ord, name AS table_name, col_ord, col_name AS name, data_type,
        is_nullable, is_primary_key, is_foreign_key, refs AS "references" FROM cols""",
    "ddl_constraints": _WITH_DDL
    + """SELECT relative_path, table_ord, name AS table_name, 0 AS constraint_ord,
        CASE WHEN has_check THEN concat('CONSTRAINT chk_', CAST(k AS STRING), ' CHECK (amount >= 0)')
             ELSE 'UNIQUE (id, status)' END AS constraint_text FROM tabs WHERE has_constraint""",
    "ddl_triggers": _WITH_DDL
    + f"""SELECT t.relative_path, table_ord, name AS table_name, {TRIGGER_TEXT} AS trigger_text
        FROM tabs t JOIN keys USING (k) WHERE has_trigger""",
    "column_pii": _WITH_DDL
    + """SELECT relative_path, table_ord, col_ord, col_name AS name, classification, is_violation,
        risk_reason, remediation_hint FROM pii""",
    "invariant_tables": _WITH_DDL
    + """SELECT relative_path, table_ord, name, NOT has_money OR has_check AS is_sound,
        CASE WHEN NOT has_money THEN 'Non-ledger table. Invariant check skipped.'
             WHEN has_check THEN 'forall t in ledger: t.debit >= 0 && t.credit >= 0 && CHECK_PASSED(t)'
             ELSE '!(debit >= 0 && credit >= 0 && SUM(debit) == SUM(credit))' END AS proof_expression,
        CASE WHEN has_money AND NOT has_check THEN 'A negative balance transaction or unmatched debit can be inserted without database rejection.'
             ELSE '' END AS counter_example FROM tabs""",
    "archive_files": """WITH d AS (SELECT doc_id, doc_id // 50 AS b, text FROM documents)
        SELECT concat(CAST(b AS STRING), CASE WHEN b % 2 = 0 THEN '.zip' ELSE '.TAR.GZ' END) AS archive,
          CASE WHEN doc_id % 3 = 1 THEN concat('docs/', CAST(doc_id AS STRING), '.sql')
               ELSE concat(CASE WHEN b % 2 = 0 THEN 'a/' ELSE '' END, 'docs/', CAST(doc_id AS STRING), '.sql') END AS relative_path,
          md5(text) AS content_md5
        FROM d WHERE doc_id % 3 <> 0 AND b % 7 <> 3 AND b % 11 <> 5 AND b % 13 <> 6""",
    "archive_rejects": """SELECT concat(CAST(b AS STRING), CASE WHEN b % 11 = 5 THEN '.rar'
            WHEN b % 2 = 0 THEN '.zip' ELSE '.TAR.GZ' END) AS archive,
          CASE WHEN b % 11 = 5 THEN 'unsupported archive format'
               WHEN b % 13 = 6 AND b % 2 = 1 THEN 'unreadable archive: EOFError'
               WHEN b % 7 = 3 THEN 'unsafe member: x/../../evil.sql'
               ELSE 'unreadable archive: BadZipFile' END AS reason
        FROM (SELECT DISTINCT doc_id // 50 AS b FROM documents)
        WHERE b % 11 = 5 OR b % 7 = 3 OR b % 13 = 6""",
    "schema_findings": _WITH_FOUND + "SELECT * EXCLUDE (db, k) FROM found",
    "findings_of_framework": _WITH_FOUND
    + f"""SELECT CASE rule_id WHEN 'FIN-IMM-002' THEN 0 ELSE 1 END AS rule_ord, rule_id, relative_path, table_ord
        FROM found WHERE framework = {_q(CYBERSECURITY)}""",
    "custom_rule_findings": _WITH_DDL
    + """SELECT 'USER-001' AS rule_id, relative_path, name AS table_name,
        concat(name, ' has ', CAST(count(*) AS STRING), ' columns') AS description, 'LOW' AS risk_tier
        FROM cols GROUP BY relative_path, table_ord, name HAVING count(*) >= 5 AND bool_or(is_foreign_key)""",
    "schema_rule_results": _WITH_FOUND + _results(SCHEMA_RULE_TEXTS, "found"),
    "findings_per_tier": _WITH_FOUND
    + f"""SELECT v.risk_tier, count(f.rule_id) AS finding_count
        FROM (VALUES {_TIER_ROWS}) AS v(risk_tier, w) LEFT JOIN found f USING (risk_tier) GROUP BY 1""",
    "findings_per_framework": _WITH_FOUND
    + f"""SELECT v.framework, count(f.rule_id) AS finding_count
        FROM (VALUES {", ".join(f"({_q(f)})" for f in FRAMEWORKS)}) AS v(framework)
        LEFT JOIN found f USING (framework) GROUP BY 1""",
    "findings_per_tab": _WITH_FOUND
    + f"""SELECT v.risk_tier, count(f.rule_id) AS finding_count
        FROM (VALUES {_TIER_ROWS}) AS v(risk_tier, w) LEFT JOIN found f USING (risk_tier) GROUP BY 1
        UNION ALL SELECT 'ALL', count(*) FROM found""",
    "audit_totals": _totals(""),
    "audit_totals_per_database": _totals("db"),
    "findings_search": _WITH_FOUND
    + """SELECT rule_id, relative_path, table_name, column_name FROM found
        WHERE risk_tier = 'CRITICAL' AND (contains(lower(title), 'wallet') OR contains(lower(rule_id), 'wallet')
          OR contains(lower(table_name), 'wallet') OR contains(lower(description), 'wallet'))""",
    "findings_details": _WITH_FOUND
    + f"""SELECT rule_id, risk_tier, framework, {_TABLE_OR_NA} AS table_name,
        CASE WHEN column_name = '' THEN 'N/A' ELSE column_name END AS column_name, file_path,
        'N/A' AS line_number, code_snippet, remediation FROM found""",
    "findings_remediation": _WITH_FOUND
    + f"SELECT rule_id, {_TABLE_OR_NA} AS table_name, risk_tier, remediation FROM found",
    "findings_sarif": _WITH_FOUND
    + f"""SELECT rule_id, CASE risk_tier WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error'
          WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
        concat(description, ' (Table: ', {_TABLE_OR_NA}, ')') AS message, file_path AS uri,
        CAST(1 AS BIGINT) AS start_line FROM found""",
    "first_findings": _WITH_FOUND
    + """SELECT rule_id, title, relative_path, table_ord, col_ord, description FROM found
        QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY relative_path, table_ord, col_ord) = 1""",
    "broken_rules_per_table": _WITH_FOUND
    + """SELECT table_name, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids
        FROM found WHERE table_name <> '' GROUP BY 1""",
    "unbalanced_orders": """WITH e AS (
        SELECT o_orderkey AS entry, CAST(o_totalprice AS DECIMAL(18,2)) AS debit, CAST(0 AS DECIMAL(18,2)) AS credit FROM orders
        UNION ALL SELECT l_orderkey, 0, CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem)
        SELECT entry, CAST(sum(debit) AS DOUBLE) AS total_debit, CAST(sum(credit) AS DOUBLE) AS total_credit
        FROM e GROUP BY 1 HAVING sum(debit) <> sum(credit)""",
    "negative_balances": "SELECT c_custkey, c_acctbal AS debit FROM customer WHERE c_acctbal < 0",
    "final_schema_tables": f"""WITH {_MIGRATION}
        SELECT {_MDB} AS db, concat('ledger_', CAST(k AS STRING)) AS table_key,
          concat('Ledger_', CAST(k AS STRING)) AS name, true AS is_ledger_table,
          concat({_DIR}, '0000_init.sql') AS first_file, reset_path AS last_file FROM resets
        UNION ALL
        SELECT {_MDB}, concat('audit_', CAST(k AS STRING)), concat('audit_', CAST(k AS STRING)), false,
          concat({_DIR}, '0000_init.sql'), concat({_DIR}, '0000_init.sql') FROM resets""",
    "final_schema_columns": f"""WITH {_MIGRATION}
        SELECT {_MDB} AS db, concat('ledger_', CAST(k AS STRING)) AS table_key,
          CAST(row_number() OVER (PARTITION BY k ORDER BY first_at) - 1 AS INT) AS col_ord,
          name, data_type, is_nullable, is_primary_key FROM kept
        UNION ALL
        SELECT {_MDB}, concat('audit_', CAST(k AS STRING)), c.pos, c.name, c.data_type, true, false
        FROM base, LATERAL (VALUES (0, 'id', 'INT'), (1, 'bvn', 'CHAR(11)')) AS c(pos, name, data_type)""",
    "final_schema_audit": f"""WITH {_MIGRATION}, judged AS (SELECT *, {_MDB} AS db FROM base)
        SELECT db, r.rule_ord, c.rule_id, 'reconstituted_final_schema.sql' AS relative_path, c.table_name, c.column_name
        FROM judged JOIN chains USING (db), LATERAL (VALUES
          (true, 'FIN-DE-001', concat('Ledger_', CAST(k AS STRING)), ''),
          (true, 'FIN-IMM-001', concat('Ledger_', CAST(k AS STRING)), ''),
          (k % 5 <> 0, 'FIN-IMM-002', concat('Ledger_', CAST(k AS STRING)), ''),
          (true, 'FIN-PII-001', concat('audit_', CAST(k AS STRING)), 'bvn')) AS c(present, rule_id, table_name, column_name)
        JOIN {_rule_rows(SCHEMA_RULE_TEXTS)} ON r.rule_id = c.rule_id WHERE c.present""",
    "audit_totals_with_final_schema": f"""WITH {_MIGRATION},
        sized AS (SELECT db, count(*) AS files FROM ({MIGRATION_SQL}) GROUP BY db),
        judged AS (
          SELECT {_MDB} AS db, c.* FROM base, LATERAL (VALUES
            (true, false, 2, 1, 'FIN-DE-001'), (true, false, 0, 0, 'FIN-IMM-001'), (true, false, 0, 0, 'FIN-IMM-002'),
            (true, false, 0, 0, 'FIN-PII-001'),
            (k % 5 = 0, false, 1, 1, 'FIN-DE-001'), (k % 5 = 0, false, 0, 0, 'FIN-IMM-001'),
            (k % 5 = 0, false, 0, 0, 'FIN-CBN-001'),
            (true, true, 2, 1, 'FIN-DE-001'), (true, true, 0, 0, 'FIN-IMM-001'),
            (k % 5 <> 0, true, 0, 0, 'FIN-IMM-002'), (true, true, 0, 0, 'FIN-PII-001')
          ) AS c(present, of_chain, tables, ledgers, rule_id)
          WHERE c.present),
        counted AS (
          SELECT j.*, s.files, CASE WHEN rule_id IN ('FIN-IMM-002', 'FIN-CBN-001') THEN 'HIGH' ELSE 'CRITICAL' END AS tier
          FROM judged j JOIN sized s USING (db) WHERE NOT of_chain OR s.files > 1)
        SELECT db, files + CASE WHEN files > 1 THEN 1 ELSE 0 END AS total_files_scanned,
          CAST(sum(tables) AS BIGINT) AS total_tables_audited, CAST(sum(ledgers) AS BIGINT) AS total_ledger_tables_found,
          CAST(0 AS BIGINT) AS total_secrets_redacted, count(*) AS total_findings,
          count(*) FILTER (tier = 'CRITICAL') AS critical_findings, count(*) FILTER (tier = 'HIGH') AS high_findings,
          CAST(0 AS BIGINT) AS medium_findings, CAST(0 AS BIGINT) AS low_findings, 'CRITICAL' AS overall_risk_tier,
          round((8 - count(DISTINCT rule_id)) * 100.0 / 8, 1)::DOUBLE AS compliance_score
        FROM counted GROUP BY db, files""",
    "final_schema_paths": f"""SELECT db, 'reconstituted_final_schema.sql' AS relative_path, count(*) AS file_count
        FROM ({MIGRATION_SQL}) GROUP BY db UNION ALL SELECT 'db_empty', 'unified_schema.sql', 0""",
    "final_schema_texts": f"""WITH texts AS (
          SELECT *, row_number() OVER (PARTITION BY db ORDER BY relative_path) AS n FROM ({MIGRATION_SQL}))
        SELECT db, relative_path, 1 AS at, content AS line FROM texts
        UNION ALL SELECT db, relative_path, 0, '' FROM texts WHERE n > 1""",
    "migration_chains": f"""WITH {_MIGRATION} SELECT db, file_count, path,
        'Generic SQL / Migration DDL' AS engine_type, false AS has_cascade_text,
        CAST(0 AS BIGINT) AS secret_count FROM chains""",
    "remediation_sql": f"""{_WITH_FOUND.replace("found AS (", "found0 AS (", 1)},
        found AS (SELECT *, CASE WHEN table_name = '' THEN 'target_table' ELSE table_name END AS named FROM found0)
        SELECT rule_ord, relative_path, table_ord, col_ord, stmt_ord, named AS table_name, statement
        FROM ({_STATEMENT_ROWS})""",
    "findings_table": _WITH_FOUND
    + "SELECT rule_id, risk_tier, file_path, table_name, column_name, description, reference FROM found",
    "remediation_script_lines": f"""{_WITH_FOUND.replace("found AS (", "found0 AS (", 1)},
        found AS (SELECT *, CASE WHEN table_name = '' THEN 'target_table' ELSE table_name END AS named FROM found0),
        parts AS (
          SELECT 0 AS section, * FROM (VALUES
            (0, concat('-- ', repeat('=', 68))), (1, '-- tallyguard: automated SQL remediation script'),
            (2, '-- Target: /data/schemas'), (3, '-- Fingerprint: 0123456789abcdef')) AS t(spot, line)
          UNION ALL SELECT 1, 0, concat('-- Total Findings: ', CAST(count(*) AS STRING)) FROM found
          UNION ALL SELECT 2, 0, concat('-- ', repeat('=', 68), chr(10))
          UNION ALL SELECT 3, row_number() OVER (ORDER BY rule_ord, relative_path, table_ord NULLS FIRST,
              col_ord NULLS FIRST, stmt_ord), statement FROM ({_STATEMENT_ROWS}))
        SELECT row_number() OVER (ORDER BY section, spot) - 1 AS place, line FROM parts""",
    "findings_by_severity": _WITH_FOUND
    + f"""SELECT row_number() OVER (ORDER BY w DESC, rule_ord, relative_path, table_ord, col_ord) - 1 AS place,
          risk_tier, rule_id, relative_path, table_ord, col_ord
        FROM found JOIN (VALUES {_TIER_ROWS}) AS v(risk_tier, w) USING (risk_tier)""",
    "patched_ddl": f"{_WITH_FOUND}, {_BROKEN} SELECT db, table_name, relative_path, patched_ddl FROM rewritten",
    "patched_schema": f"""{_WITH_FOUND}, {_BROKEN},
        main AS (SELECT k, patched_ddl FROM rewritten WHERE table_ord = 0),
        audit AS (SELECT k, patched_ddl FROM rewritten WHERE table_ord = 1),
        whole AS (SELECT db, relative_path, k, {DDL_CONTENT} AS content, {DDL_CREATE} AS created,
            concat('CREATE TABLE audit_log_', {KEY}, ' (id BIGINT PRIMARY KEY, note TEXT);') AS audit_created
          FROM keys WHERE NOT is_prisma)
        SELECT db, relative_path, replace(replace(content, created, coalesce(main.patched_ddl, created)),
            audit_created, coalesce(audit.patched_ddl, audit_created)) AS patched_content
        FROM whole LEFT JOIN main USING (k) LEFT JOIN audit USING (k)""",
    "guard_triggers": f"""{_WITH_FOUND}
        SELECT DISTINCT db, table_name, {_fill(GUARD_TEXT, 'table_name')} AS statement
        FROM found WHERE rule_id = 'FIN-IMM-001'""",
    "orders_merkle_root": """WITH RECURSIVE leaves AS (
          SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
            sha256(concat(CAST(o_orderkey AS STRING), '|', o_orderstatus)) AS h FROM orders),
        tree(lvl, i, h) AS (
          SELECT 0, i, h FROM leaves
          UNION ALL
          SELECT lvl + 1, i // 2, sha256(concat(arg_min(h, i), arg_max(h, i))) FROM tree
          WHERE (SELECT count(*) FROM tree) > 1
          GROUP BY lvl, i // 2)
        SELECT (SELECT count(*) FROM orders) AS leaf_count, h AS merkle_root
        FROM tree WHERE lvl = (SELECT max(lvl) FROM tree)""",
    "nation_merkle_roots": """WITH RECURSIVE leaves AS (
          SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE c_nationkey END AS nation, o_orderkey,
            sha256(concat(CAST(o_orderkey AS STRING), '|', o_orderstatus)) AS h
          FROM orders JOIN customer ON o_custkey = c_custkey),
        numbered AS (
          SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY o_orderkey) - 1 AS i, h,
            count(*) OVER (PARTITION BY nation) AS n FROM leaves),
        tree(nation, i, h, n, lvl) AS (
          SELECT nation, i, h, n, 0 FROM numbered
          UNION ALL
          SELECT nation, i // 2, sha256(concat(arg_min(h, i), arg_max(h, i))), (n + 1) // 2, lvl + 1
          FROM tree WHERE n > 1 GROUP BY nation, i // 2, n, lvl)
        SELECT nation, (SELECT count(*) FROM leaves l WHERE l.nation = tree.nation) AS leaf_count,
          h AS merkle_root FROM tree WHERE n = 1""",
    "schema_claims": f"""{_WITH_FOUND}, results AS ({_results(SCHEMA_RULE_TEXTS, "found")})
        SELECT rule_ord, concat('rule:', rule_id, '|passed:', CASE WHEN passed THEN 'True' ELSE 'False' END,
          '|framework:', framework) AS claim FROM results""",
    "attestation": f"""{_WITH_FOUND}, results AS ({_results(SCHEMA_RULE_TEXTS, "found")}),
        h0 AS (SELECT rule_ord AS i, sha256(concat('rule:', rule_id, '|passed:', CASE WHEN passed THEN 'True' ELSE 'False' END,
          '|framework:', framework)) AS h FROM results),
        h1 AS (SELECT i // 2 AS i, sha256(concat(arg_min(h, i), arg_max(h, i))) AS h FROM h0 GROUP BY 1),
        h2 AS (SELECT i // 2 AS i, sha256(concat(arg_min(h, i), arg_max(h, i))) AS h FROM h1 GROUP BY 1),
        h3 AS (SELECT sha256(concat(arg_min(h, i), arg_max(h, i))) AS root FROM h2),
        s AS (SELECT round(avg(CASE WHEN passed THEN 100.0 ELSE 0.0 END), 1)::DOUBLE AS compliance_score FROM results),
        n AS (SELECT count(*) AS n, CASE max(CASE risk_tier WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
              WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM found)
        SELECT '2.0.0-ZK' AS zk_proof_version, '0123456789abcdef' AS target_fingerprint,
          '2024-01-01T00:00:00+00:00' AS timestamp, root AS merkle_root, compliance_score,
          tier AS overall_risk_tier, n AS total_findings_count,
          sha256(concat('AUDIT_V1|0123456789abcdef|', root, '|', CAST(compliance_score AS STRING))) AS zero_knowledge_verifier_hash
        FROM h3, s, n""",
    "fingerprints": """SELECT page_id,
        left(sha256(concat(url, '|2024-01-01T00:00:00+00:00')), 16) AS fingerprint FROM pages""",
}

# --- documents per database -----------------------------------------------------------------------
#
# Parts are (db, section, spot, line); a line's place is its rank among the lines of its database.

_PLACED = """SELECT db, row_number() OVER (PARTITION BY db ORDER BY section, spot) - 1 AS place, line FROM parts"""
_FINDING_JSON = """CAST(json_object('rule_id', rule_id, 'title', title, 'description', description,
  'framework', framework, 'risk_tier', risk_tier, 'file_path', file_path, 'line_number', NULL,
  'table_name', nullif(table_name, ''), 'column_name', nullif(column_name, ''), 'code_snippet', '',
  'remediation', remediation, 'reference', reference) AS VARCHAR)"""


def _object(pairs: list[tuple[str, str]]) -> str:
    return "json_object(" + ", ".join(f"{_q(name)}, {value}" for name, value in pairs) + ")"


def _lines_of(section: int, texts: list[str]) -> str:
    rows = ", ".join(f"({i}, {text})" for i, text in enumerate(texts))
    return f"SELECT db, {section} AS section, spot, line FROM groups, (VALUES {rows}) AS v(spot, line)"


def _listed(section: int, source: str, order: str, json: str) -> str:
    return f"""SELECT db, {section}, row_number() OVER (PARTITION BY db ORDER BY {order}),
      concat(CASE WHEN row_number() OVER (PARTITION BY db ORDER BY {order}) = 1 THEN '' ELSE ',' END, {json})
      FROM {source}"""


_FINDING_ORDER = "rule_ord, relative_path, table_ord, col_ord"
_FRAMEWORK_COUNTS = _object(
    [(f, f"(SELECT count(*) FROM found x WHERE x.db = t.db AND x.framework = {_q(f)})") for f in FRAMEWORKS]
)
_SUMMARY_JSON = _object(
    [
        *((c, c) for c in (
            "total_files_scanned", "total_tables_audited", "total_ledger_tables_found",
            "total_secrets_redacted", "overall_risk_tier", "compliance_score",
        )),
        ("risk_breakdown", _object([(t, f"{t.lower()}_findings") for t, _ in TIERS])),
        ("framework_breakdown", _FRAMEWORK_COUNTS),
    ]
)
_METADATA_JSON = """{"tool":"tallyguard","version":"1.0.0","scan_target":"/data/schemas","fingerprint":"0123456789abcdef","scan_started_at":"2024-01-01T00:00:00+00:00","scan_completed_at":"2024-01-01T00:01:00+00:00"}"""
_REPORT = f"""{_WITH_FOUND}, groups AS (SELECT DISTINCT db FROM keys), totals AS ({_totals("db")}),
    results AS (
      SELECT g.db, r.rule_ord, r.rule_id, r.title AS rule_name, r.framework, count(f.rule_id) AS n
      FROM groups g CROSS JOIN {_rule_rows(SCHEMA_RULE_TEXTS)}
      LEFT JOIN found f ON f.rule_id = r.rule_id AND f.db = g.db WHERE r.case_ord = 0 GROUP BY ALL),
    parts AS (
      {_lines_of(0, [_q('{"metadata":')])} UNION ALL {_lines_of(1, [_q(_METADATA_JSON)])}
      UNION ALL {_lines_of(2, [_q(',"summary":')])}
      UNION ALL SELECT db, 3, 0, CAST({_SUMMARY_JSON} AS VARCHAR) FROM totals t
      UNION ALL {_lines_of(4, [_q(',"findings":[')])}
      UNION ALL {_listed(5, "found", _FINDING_ORDER, _FINDING_JSON)}
      UNION ALL {_lines_of(6, [_q('],"rules":[')])}
      UNION ALL {_listed(7, "results", "rule_ord", "CAST(json_object('rule_id', rule_id, 'rule_name', rule_name, 'framework', framework, 'passed', n = 0, 'finding_count', n) AS VARCHAR)")}
      UNION ALL {_lines_of(8, [_q("]}")])})
    {_PLACED}"""

_SARIF_RULE = """CAST(json_object('id', rule_id, 'name', title, 'shortDescription', json_object('text', title),
  'fullDescription', json_object('text', description),
  'help', json_object('text', concat('Remediation: ', remediation, chr(10), 'Reference: ', reference)),
  'properties', json_object('tags', json_array('compliance', 'financial-ledger', framework), 'precision', 'high')) AS VARCHAR)"""
_SARIF_RESULT = f"""CAST(json_object('ruleId', rule_id, 'level', CASE risk_tier WHEN 'CRITICAL' THEN 'error'
    WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END,
  'message', json_object('text', concat(description, ' (Table: ', {_TABLE_OR_NA}, ')')),
  'locations', json_array(json_object('physicalLocation', json_object(
    'artifactLocation', json_object('uri', file_path), 'region', json_object('startLine', 1))))) AS VARCHAR)"""
_SARIF = f"""{_WITH_FOUND}, groups AS (SELECT DISTINCT db FROM keys),
    firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY db, rule_id ORDER BY {_FINDING_ORDER}) = 1),
    parts AS (
      {_lines_of(0, [
          _q('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0",'),
          _q('"runs":[{"tool":{"driver":{"name":"tallyguard","version":"1.0.0","rules":['),
      ])}
      UNION ALL {_listed(1, "firsts", "rule_ord", _SARIF_RULE)}
      UNION ALL {_lines_of(2, [_q("]}},"), _q('"results":[')])}
      UNION ALL {_listed(3, "found", _FINDING_ORDER, _SARIF_RESULT)}
      UNION ALL {_lines_of(4, [_q("]}]}")])})
    {_PLACED}"""

_PATCHED_SCHEMA = _TABLES["patched_schema"]
_RULER = "concat('-- ', repeat('=', 68))"
_FIXED_SCHEMA = f"""{_WITH_FOUND}, groups AS (SELECT DISTINCT db FROM keys),
    with_sql AS (SELECT DISTINCT db FROM keys WHERE NOT is_prisma),
    texts AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY relative_path) AS n FROM ({_PATCHED_SCHEMA})),
    guards AS (
      SELECT db, table_name, min((relative_path, table_ord)) AS first
      FROM found WHERE rule_id = 'FIN-IMM-001' AND db IN (SELECT db FROM with_sql) GROUP BY ALL),
    parts AS (
      {_lines_of(0, [_RULER, _q("-- tallyguard: database schema with remediations applied"), f"concat({_RULER}, chr(10))"])}
      UNION ALL {_lines_of(1, ["concat(chr(10), '-- No .sql files found to rewrite.')"])} WHERE db NOT IN (SELECT db FROM with_sql)
      UNION ALL SELECT db, 1, 2 * n, '' FROM texts WHERE n > 1
      UNION ALL SELECT db, 1, 2 * n + 1, patched_content FROM texts
      UNION ALL {_lines_of(2, ["concat(chr(10), chr(10), '-- Remediation Triggers & Audit Tables')"])} WHERE db IN (SELECT db FROM with_sql)
      UNION ALL SELECT db, 3, row_number() OVER (PARTITION BY db ORDER BY first), {_fill(GUARD_TEXT, 'table_name')} FROM guards
      UNION ALL {_lines_of(4, [f"concat(chr(10), {_q(AUDIT_LOG_TEXT)})"])} WHERE db IN (SELECT db FROM with_sql))
    {_PLACED}"""

ORACLES: dict[str, str] = _TABLES | {
    "report_lines": _REPORT,
    "sarif_lines": _SARIF,
    "fixed_schema_lines": _FIXED_SCHEMA,
}
