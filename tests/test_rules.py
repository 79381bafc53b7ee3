"""Rules on fixed corpora, and the carried CORS state against a loop."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyguard.operators.cors import cors_block_findings
from tallyguard.plans import audit
from tallyguard.rules.engine import line_matches
from tallyguard.operators.findings import (
    filter_findings,
    finding_details,
    first_per_rule,
    remediation_matrix,
    rules_per_table,
)
from tallyguard.operators.summaries import (
    audit_summary,
    compliance_score,
    framework_summary,
    overall_tier,
    risk_summary,
    rule_results,
    tab_counts,
)
from tallyguard.plans.audit import (
    audited_files,
    findings_of,
    line_findings,
    line_findings_of_files,
)
from tallyguard.rules.catalog import LINE_RULES, SCHEMA_RULES
from tallyguard.rules.model import FILE, Rule, by_framework

CONFIG = {
    "queue.env": """BROKER=redis://sorter:pl4nt@broker.plant.test:6380/2
SIGNING=sk_live_7f3c9a0011
DEBUG = true
QUIET=yes
""",
    "gate.yaml": """gate:
  cors:
    headers: "accept"
    hosts: ['*']
journal:
  store: mongodb://reader:r3ad@docs.plant.test/events
  encryption: off
  retention: 14
  debug: true
""",
    "store.tf": """resource "pool" "books" {
  kind      = "mysql"
  encrypted = none
}
""",
    "calm.yaml": """listen: 10.0.0.4
store:
  sslmode: verify-full
  encryption: aes
retention: 400
hosts: "https://desk.plant.test"
""",
}


def test_schema_rules(files_of, sql_schema, prisma_schema):
    audited = audited_files(files_of({"schema.sql": sql_schema, "schema.prisma": prisma_schema}))
    found = findings_of(audited).collect()
    assert Counter((r["relative_path"], r["rule_id"]) for r in found) == {
        ("schema.sql", "FIN-DE-001"): 2,
        ("schema.sql", "FIN-DE-002"): 2,
        ("schema.sql", "FIN-PII-001"): 2,
        ("schema.sql", "FIN-PII-002"): 1,
        ("schema.sql", "FIN-IMM-001"): 2,
        ("schema.sql", "FIN-IMM-002"): 2,
        ("schema.prisma", "FIN-DE-001"): 1,
        ("schema.prisma", "FIN-PII-001"): 1,
        ("schema.prisma", "FIN-PII-002"): 1,
        ("schema.prisma", "FIN-IMM-001"): 1,
        ("schema.prisma", "FIN-IMM-002"): 1,
        ("schema.prisma", "FIN-CBN-001"): 1,
        ("schema.prisma", "FIN-CBN-002"): 1,
    }
    assert {r["column_name"] for r in found if r["rule_id"] == "FIN-PII-002"} == {"old_card_pan", "panDigits"}


def test_summaries(files_of, sql_schema):
    audited = audited_files(files_of({"schema.sql": sql_schema}))
    findings = findings_of(audited)
    assert [tuple(r) for r in risk_summary(findings).collect()] == [
        ("CRITICAL", 9), ("HIGH", 2), ("MEDIUM", 0), ("LOW", 0),
    ]
    assert [r["finding_count"] for r in tab_counts(findings).collect()] == [11, 9, 2, 0, 0]
    assert sum(r["finding_count"] for r in framework_summary(findings).collect()) == 11
    results = rule_results(findings, SCHEMA_RULES)
    assert results.filter("passed").count() == 2
    assert compliance_score(results).first()[0] == 25.0
    assert overall_tier(findings).first()[0] == "CRITICAL"
    [row] = audit_summary(audited, SCHEMA_RULES).collect()
    assert (row["total_tables_audited"], row["total_ledger_tables_found"]) == (3, 2)
    assert (row["compliance_score"], row["overall_risk_tier"], row["low_findings"]) == (25.0, "CRITICAL", 0)


def test_empty_corpus(files_of, spark):
    audited = audited_files(files_of({"a.sql": "x"}).limit(0))
    findings = findings_of(audited)
    assert overall_tier(findings).first()[0] == "LOW"
    assert [r["finding_count"] for r in risk_summary(findings).collect()] == [0, 0, 0, 0]
    [row] = audit_summary(audited, SCHEMA_RULES).collect()
    assert (row["total_files_scanned"], row["compliance_score"], row["overall_risk_tier"]) == (0, 100.0, "LOW")


def test_trigger_and_check_satisfy_the_rules(files_of):
    text = (
        "CREATE TABLE ledger (amount int, created_at date, CHECK (amount > 0));\n"
        "CREATE TABLE audit (id int);\n"
        "CREATE TRIGGER t BEFORE UPDATE OR DELETE ON ledger FOR EACH ROW EXECUTE f();"
    )
    assert findings_of(audited_files(files_of({"a.sql": text}))).count() == 0


def test_cascade_inside_a_secret_does_not_count(files_of):
    text = "CREATE TABLE ledger (created date);\nCREATE TABLE a_log (x int);\n-- secret_key = 'on delete cascade'"
    ids = {r["rule_id"] for r in findings_of(audited_files(files_of({"a.sql": text}))).collect()}
    assert ids == {"FIN-IMM-001"}


def test_queries_over_findings(files_of, sql_schema):
    findings = findings_of(audited_files(files_of({"schema.sql": sql_schema})))
    assert filter_findings(findings, "HIGH", "").count() == 2
    assert filter_findings(findings, "ALL", "OLD_CARD_PAN").count() == 1
    assert filter_findings(findings, "CRITICAL", "fee_journal").count() == 3
    assert filter_findings(findings, "LOW").count() == 0
    details = finding_details(findings).collect()
    assert [r["risk_tier"] for r in details] == ["CRITICAL"] * 9 + ["HIGH"] * 2
    assert {r["line_number"] for r in details} == {"N/A"}
    assert remediation_matrix(findings).first()["table_name"] == "fee_journal"
    assert first_per_rule(findings).count() == 6
    [row] = rules_per_table(findings).filter("table_name = 'patients'").collect()
    assert row["rule_ids"] == ["FIN-PII-001", "FIN-PII-002"]


def test_rules_of_one_framework_and_own_rules(files_of):
    chosen = by_framework(SCHEMA_RULES, SCHEMA_RULES[5].framework)
    assert [r.rule_id for r in chosen] == ["FIN-IMM-002", "FIN-CBN-002"]
    own = Rule("MY-1", "Any file", "mine", "LOW", FILE, lambda s: F.lit(True), lambda s: s.file["path"])
    rows = findings_of(audited_files(files_of({"a.sql": "x", "b.sql": "y"}), [own])).collect()
    assert sorted(r["description"] for r in rows) == ["a.sql", "b.sql"]


def test_line_rules(files_of):
    rows = line_findings_of_files(files_of(CONFIG)).collect()
    got: dict[str, list] = {}
    for r in rows:
        got.setdefault(r["rule_id"], []).append((r["relative_path"], r["line_number"]))
    env, gate, store = "queue.env", "gate.yaml", "store.tf"
    assert {k: sorted(v) for k, v in got.items()} == {
        "CBN-001": [(gate, 6), (env, 1), (env, 2)],
        "CBN-002": [(gate, 4)],
        "CBN-003": [(gate, 8)],
        "CBN-004": [(gate, 9), (env, 3)],
        "NDPA-001": [(gate, 6), (env, 1), (env, 2), (store, 2)],
        "NDPA-002": [(gate, 7), (store, 3)],
    }


LINES = [
    ("Access-Control-Allow-Origin : *", "CBN-002", True),
    ("retention 089", "CBN-003", True),
    ("retention = 000000000000000000000000000000000000000000007", "CBN-003", True),
    ("retention 90", "CBN-003", False),
    ("retention 12345678901234567890123456789012345678901234567890", "CBN-003", False),
    ("retention x", "CBN-003", False),
    ("retention ١٢", "CBN-003", True),
    ("debug : true", "CBN-004", True),
    ("Debug=true", "CBN-004", False),
    ("Rate Limiting = FALSE", "CBN-005", True),
    ("rateLimit = 0", "CBN-005", True),
    ("rate_limit = false", "CBN-005", True),
    ("rate_limit = 10", "CBN-005", False),
    ("port = 3306", "CBN-006", True),
    ("port = 5433", "CBN-006", False),
    ("keep never_expire", "NDPA-004", True),
    ("retention=unlimited", "NDPA-004", True),
    ("bind = 0.0.0.0", "CBN-006", True),
    ("PORT : 27017", "CBN-006", True),
    ("see http://LOCALHOST/x", "NDPA-001", False),
    ("see HTTP://x", "NDPA-001", True),
    ("mysql ssl=true", "NDPA-001", False),
    ("Encrypted : None", "NDPA-002", True),
    ("a12345678901", "NDPA-003", False),
    ("_12345678901", "NDPA-003", False),
    ("(12345678901)", "NDPA-003", True),
    ("Never_Expire", "NDPA-004", True),
    ("analytics consent=false", "NDPA-005", True),
]


def test_single_lines(spark):
    rows = [(str(i), 1, line) for i, (line, _, _) in enumerate(LINES)]
    frame = spark.createDataFrame(rows, "relative_path string, line_number bigint, line string")
    found = {(int(r["relative_path"]), r["rule_id"]) for r in line_findings(frame).collect()}
    for i, (line, rule, holds) in enumerate(LINES):
        assert ((i, rule) in found) is holds, (line, rule)


# what a line does to the state of its file: opens a block, is a wildcard that counts in one, both, or nothing
ROLES = {
    "open": ["cors:", "allowed_origins:"],
    "wild": ["- '*'", '- "*"', "Origin: *"],
    "both": ["allowed_origins: '*'"],
    "rest": ["x", "y: 1", "origin: '*'"],
}


def test_cors_state_over_blocks(spark):
    rng = random.Random(11)
    rows, expected = [], set()
    for i in range(30):
        roles = [rng.choice(["open", "wild", "wild", "both", "rest", "rest", "rest"]) for _ in range(rng.randint(0, 60))]
        rows += [(f"f{i}", n, rng.choice(ROLES[role])) for n, role in enumerate(roles, 1)]
        # the first wildcard after each opening counts, up to the next opening
        opened = [n for n, role in enumerate(roles, 1) if role in ("open", "both")]
        for n in opened:
            wild = [m for m, role in enumerate(roles, 1) if m >= n and role in ("wild", "both")]
            expected |= {(f"f{i}", m) for m in wild[:1]}
    frame = spark.createDataFrame(rows, "relative_path string, line_number bigint, line string")
    for size in (3, 1000):
        found = cors_block_findings(frame, LINE_RULES, lines_per_block=size)
        got = found.collect()
        # the lines are read and searched once
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Scan ") == 1
        assert {(r["relative_path"], r["line_number"]) for r in got} == expected
        assert len(got) == len(expected)


def test_all_line_rules_search_the_lines_once(spark, monkeypatch):
    rows = [("f", n, line) for n, line in enumerate(["cors:", "origin: *", "DEBUG=true", "x"] * 9, 1)]
    frame = spark.createDataFrame(rows, "relative_path string, line_number bigint, line string")
    searched = []
    monkeypatch.setattr(audit, "line_matches", lambda *a: searched.append(a) or line_matches(*a))
    found = audit.line_findings(frame)
    assert len(searched) == 1
    counts = Counter((r["rule_id"], r["sub_ord"]) for r in found.collect())
    assert counts == {("CBN-002", 1): 9, ("CBN-004", 0): 9}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # what is left to do reads the stored matches
    assert "replace(" not in plan and "RLIKE" not in plan.upper()


def test_audit_is_one_pass(files_of):
    plan = findings_of(audited_files(files_of({"a.sql": "x"})))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    # statements, triggers, elements, models, and six redaction stages
    assert plan.count("regexp_extract_all(") == 10
