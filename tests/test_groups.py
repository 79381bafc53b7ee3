"""Numbering, Merkle roots and documents of many groups at once."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tallyguard.operators.findings import first_per_rule
from tallyguard.operators.merkle import merkle_roots
from tallyguard.operators.numbering import number_rows_by
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
)
from tallyguard.sources.files import with_engine

TARGET = Target("/data", "0123456789abcdef", "2024-01-01T00:00:00+00:00", "2024-01-01T00:01:00+00:00")


def root_of(claims):
    level = [hashlib.sha256(c.encode()).hexdigest() for c in claims]
    while len(level) > 1:
        level = level + level[-1:] * (len(level) % 2)
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
    return level[0]


def test_numbers_within_groups(spark):
    # one group has nearly all rows, and one has no name
    rows = [("big", i) for i in range(3000)] + [(None, i) for i in range(5)] + [(f"g{i}", i) for i in range(20)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(7)
    numbered, groups = number_rows_by(frame, ["g"], [F.desc("v")])
    got = {(r["g"], r["v"]): r["idx"] for r in numbered.collect()}
    assert got == {(g, v): sum(1 for h, w in rows if h == g and w > v) if g != "big" else 2999 - v for g, v in rows}
    assert {r["g"]: r["rows"] for r in groups.collect()} == {"big": 3000, None: 5, **{f"g{i}": 1 for i in range(20)}}


def test_roots_of_groups_of_all_sizes(spark):
    sizes = {f"g{n}": n for n in [*range(1, 20), 33, 64, 100, 257]}
    rows = [(g, i, f"{g}:{i}") for g, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i int, leaf string").repartition(5)
    wanted = {g: (n, root_of([f"{g}:{i}" for i in range(n)])) for g, n in sizes.items()}
    for levels in (1, 3, 10):
        found = merkle_roots(frame, ["g"], ["i"], "leaf", levels).collect()
        assert {r["g"]: (r["leaf_count"], r["merkle_root"]) for r in found} == wanted
    assert merkle_roots(frame.limit(0), ["g"], ["i"], "leaf").count() == 0


def _read(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_documents_of_every_database(spark, sql_schema, prisma_schema, tmp_path):
    rows = [
        ("one", "a.sql", sql_schema), ("one", "b.sql", "-- nothing"), ("two", "c.prisma", prisma_schema),
        ("three", "d.sql", "-- empty"),
    ]
    files = with_engine(spark.createDataFrame(rows, "db string, relative_path string, content string"))
    audited = audited_files(files)
    findings = findings_of(audited, ["db"])
    summary = audit_summary(audited, SCHEMA_RULES, ["db"])
    results = rule_results(findings, SCHEMA_RULES, ["db"], audited)
    made = {
        "report": json_report(findings, summary, results, TARGET, ["db"]),
        "sarif": sarif_document(findings, ["db"], audited),
        "script": remediation_script(findings, TARGET, ["db"]),
        "schema": fixed_schema(files, findings, ["db"]),
    }
    for name, document in made.items():
        write_document(document, str(tmp_path / name), ["db"])
    alone = {}
    for db in ("one", "two", "three"):
        only = findings.filter(F.col("db") == db).drop("db")
        part = audited.filter(F.col("db") == db)
        alone[db] = {
            "report": json_report(
                only, audit_summary(part, SCHEMA_RULES), rule_results(only, SCHEMA_RULES), TARGET
            ),
            "sarif": sarif_document(only),
        }
        for name, document in alone[db].items():
            write_document(document, str(tmp_path / "alone" / db / name))
            text = _read(tmp_path / name / f"db={db}")
            assert json.loads(text) == json.loads(_read(tmp_path / "alone" / db / name))
    report = json.loads(_read(tmp_path / "report" / "db=three"))
    assert report["findings"] == [] and len(report["rules"]) == len(SCHEMA_RULES)
    assert json.loads(_read(tmp_path / "sarif" / "db=three"))["runs"][0]["results"] == []
    schemas = {db: _read(tmp_path / "schema" / f"db={db}") for db in ("one", "two", "three")}
    assert "No .sql files found to rewrite" in schemas["two"] and "audit_log" not in schemas["two"]
    assert schemas["one"].index("bvn_encrypted") < schemas["one"].index("\n\n-- nothing")
    assert "-- empty" in schemas["three"] and "audit_log" in schemas["three"]
    assert "-- Total Findings: " in _read(tmp_path / "script" / "db=one")


def test_first_findings_per_group(spark):
    columns = ["rule_ord", "relative_path", "table_ord", "col_ord", "line_number", "sub_ord"]
    rows = [(g, "R", 0, p, t, None, n, 0) for g in "ab" for p in ("x", "y") for t in (2, None) for n in (None, 3)]
    frame = spark.createDataFrame(
        rows, "g string, rule_id string, rule_ord int, relative_path string, table_ord int, col_ord int, line_number int, sub_ord int"
    )
    found = first_per_rule(frame, ["g"]).collect()
    assert {(r["g"], *[r[c] for c in columns]) for r in found} == {(g, 0, "x", None, None, None, 0) for g in "ab"}
