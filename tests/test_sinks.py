"""Documents, remediation and attestation."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest

from tallyguard.functions.attestation import target_fingerprint
from tallyguard.operators.attestation import attest
from tallyguard.operators.summaries import audit_summary, rule_results
from tallyguard.plans.audit import audited_files, findings_of
from tallyguard.rules.catalog import SCHEMA_RULES
from tallyguard.sinks.documents import (
    Target,
    fixed_schema,
    json_report,
    remediation_script,
    sarif_document,
    write_document,
    write_findings,
)

TARGET = Target("/data/schemas", "0123456789abcdef", "2024-01-01T00:00:00+00:00", "2024-01-01T00:01:00+00:00")


@pytest.fixture(scope="module")
def files(files_of, sql_schema, prisma_schema):
    return files_of({"b/schema.prisma": prisma_schema, "a/schema.sql": sql_schema, "a/empty.sql": "-- nothing"}, db="one")


@pytest.fixture(scope="module")
def audited(files):
    return audited_files(files)


def _text(path: Path) -> str:
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_json_report(spark, audited, tmp_path):
    findings = findings_of(audited)
    document = json_report(findings, audit_summary(audited, SCHEMA_RULES), rule_results(findings, SCHEMA_RULES), TARGET)
    write_document(document, str(tmp_path / "report"))
    report = json.loads(_text(tmp_path / "report"))
    assert report["metadata"]["fingerprint"] == TARGET.fingerprint
    assert report["summary"]["total_tables_audited"] == 5
    assert report["summary"]["risk_breakdown"] == {"CRITICAL": 13, "HIGH": 4, "MEDIUM": 1, "LOW": 0}
    assert len(report["findings"]) == 18
    assert list(report["findings"][0]) == [
        "rule_id", "title", "description", "framework", "risk_tier", "file_path", "line_number", "table_name",
        "column_name", "code_snippet", "remediation", "reference",
    ]
    assert report["findings"][0]["line_number"] is None
    assert [f["rule_id"] for f in report["findings"]] == sorted(
        (f["rule_id"] for f in report["findings"]), key=[r.rule_id for r in SCHEMA_RULES].index
    )
    assert [r["finding_count"] for r in report["rules"]] == [3, 2, 3, 2, 3, 3, 1, 1]


def test_sarif(audited, tmp_path):
    write_document(sarif_document(findings_of(audited)), str(tmp_path / "sarif"))
    log = json.loads(_text(tmp_path / "sarif"))
    [run] = log["runs"]
    assert log["version"] == "2.1.0"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == [r.rule_id for r in SCHEMA_RULES]
    assert len(run["results"]) == 18
    first = run["results"][0]
    assert first["level"] == "error" and first["message"]["text"].endswith("(Table: fee_journal)")
    place = first["locations"][0]["physicalLocation"]
    assert place == {"artifactLocation": {"uri": "a/schema.sql"}, "region": {"startLine": 1}}


def test_sarif_without_findings(audited, tmp_path):
    write_document(sarif_document(findings_of(audited).limit(0)), str(tmp_path / "sarif"))
    assert json.loads(_text(tmp_path / "sarif"))["runs"][0]["results"] == []


def test_remediation_script(audited, tmp_path):
    write_document(remediation_script(findings_of(audited), TARGET), str(tmp_path / "sql"))
    script = _text(tmp_path / "sql")
    assert "-- Total Findings: 18\n" in script
    assert (
        "-- [FIN-DE-001] Missing Debit/Credit Balance Constraint\n"
        "-- Risk: CRITICAL | Table: fee_journal\n"
        "ALTER TABLE fee_journal ADD CONSTRAINT chk_fee_journal_balance_non_negative"
        " CHECK (debit >= 0 AND credit >= 0);\n\n"
    ) in script
    assert script.count("CREATE TRIGGER trg_prevent_mod_") == 3
    assert script.index("FIN-DE-001") < script.index("FIN-PII-001") < script.index("FIN-CBN-002")
    assert script.rstrip().endswith("-- Risk: MEDIUM | Table: N/A")


def test_fixed_schema(files, audited, tmp_path):
    document = fixed_schema(files, findings_of(audited, ["db"]), ["db"])
    write_document(document, str(tmp_path / "schema"))
    text = _text(tmp_path / "schema")
    assert "-- nothing\n\n-- A clinic" in text
    assert "    bvn_encrypted BYTEA, -- from the old register\n    nin_encrypted BYTEA" in text
    ledger = text[text.index("CREATE TABLE fee_journal"):text.index("CREATE TABLE payout_log")]
    assert "created_at TIMESTAMP WITH TIME ZONE DEFAULT CURRENT_TIMESTAMP" in ledger
    assert "CONSTRAINT chk_fee_journal_balance CHECK (debit >= 0 AND credit >= 0)\n);" in ledger
    assert text.index("prevent_fee_journal_modification") < text.index("prevent_payout_log_modification")
    assert "model ParkingWallet" not in text and "prevent_ParkingWallet_modification" in text
    assert text.rstrip().endswith("performed_at TIMESTAMP WITH TIME ZONE DEFAULT CURRENT_TIMESTAMP\n);")


def test_fixed_schema_without_sql(files_of, prisma_schema, tmp_path):
    files = files_of({"a.prisma": prisma_schema}, db="one")
    write_document(fixed_schema(files, findings_of(audited_files(files), ["db"]), ["db"]), str(tmp_path / "s"))
    assert "No .sql files found to rewrite" in _text(tmp_path / "s")


def test_findings_table(spark, audited, tmp_path):
    write_findings(findings_of(audited), str(tmp_path / "findings"))
    back = spark.read.parquet(str(tmp_path / "findings"))
    assert back.filter("risk_tier = 'HIGH'").count() == 4


def test_attestation(audited):
    record = attest(audited, SCHEMA_RULES, "f" * 16, TARGET.completed_at, "S")
    plan = record._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    [row] = record.collect()
    level = [
        hashlib.sha256(f"rule:{r.rule_id}|passed:False|framework:{r.framework}".encode()).hexdigest()
        for r in SCHEMA_RULES
    ]
    while len(level) > 1:
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
    assert row["merkle_root"] == level[0]
    verifier = hashlib.sha256(f"S|{'f' * 16}|{level[0]}|0.0".encode()).hexdigest()
    assert row["zero_knowledge_verifier_hash"] == verifier
    seed = f"{verifier}|{TARGET.completed_at}"
    assert row["proof_signature"] == hashlib.sha512(seed.encode()).hexdigest()[:64]


def test_fingerprint(spark):
    from pyspark.sql import functions as F

    [row] = spark.range(1).select(target_fingerprint(F.lit("/a"), F.lit("t")).alias("f")).collect()
    assert row["f"] == hashlib.sha256(b"/a|t").hexdigest()[:16]
