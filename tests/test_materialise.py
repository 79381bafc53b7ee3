"""What intermediate frames leave on disk."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyguard.operators import materialise as m
from tallyguard.operators.numbering import number_rows
from tallyguard.operators.replay import replay
from tallyguard.operators.extraction import with_tables
from tallyguard.sinks.documents import Target, json_report
from tallyguard.operators.summaries import audit_summary, rule_results
from tallyguard.plans.audit import audited_files, findings_of
from tallyguard.plans.chains import audit_chains
from tallyguard.rules.catalog import SCHEMA_RULES


def size(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def shuffled(spark) -> int:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data"))


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """A folder of the test's own for what is stored."""
    monkeypatch.setattr(m, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def migrations(files_of, chains=60, files=40):
    # long paths that repeat in every event, as in real trees
    texts = {}
    for k in range(chains):
        folder = f"services/{k:05}/src/main/resources/database/migrations/postgresql"
        texts[f"{folder}/0000_init.sql"] = f"CREATE TABLE ledger_{k} (id BIGINT PRIMARY KEY, amount DECIMAL(10,2));"
        for n in range(1, files):
            texts[f"{folder}/{n:04}_change.sql"] = f"ALTER TABLE ledger_{k} ADD COLUMN c{n % 7} INT;"
    return files_of(texts, db="db_main")


@pytest.mark.parametrize("store", ["materialise", "stored"])
def test_shuffles_go_with_their_job(spark, shared, store):
    rows = spark.range(200_000).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    before = shuffled(spark)
    kept = getattr(m, store)(rows.repartition(8, "h"))
    until = time.time() + 20
    while shuffled(spark) - before > 1_000_000 and time.time() < until:
        time.sleep(0.2)
    assert shuffled(spark) - before < 1_000_000
    assert kept.select(F.countDistinct("h")).first()[0] == 200_000
    assert spark.conf.get(m._SHUFFLES_GO) == "false"


def test_callers_frame_can_run_again(spark, shared):
    rows = spark.range(1000).repartition(8, "id").groupBy((F.col("id") % 7).alias("k")).count()
    first = sorted(rows.collect())
    assert sorted(m.materialise(rows).collect()) == sorted(m.stored(rows).collect()) == first
    assert sorted(rows.collect()) == first


def test_stored_keeps_names_and_values(spark, shared):
    rows = spark.sql(
        "SELECT 1 AS a, 2 AS A, array(named_struct('x', null, 'y', 'z')) AS `b c`, cast(null AS string) AS n, null AS v"
    )
    for frame in (rows, rows.drop("v")):
        for kept in (m.stored(frame), m.materialise(frame)):
            assert kept.columns == frame.columns and kept.collect() == frame.collect()
    with m.stored_meanwhile(rows.drop("v")) as kept:
        assert kept.collect() == rows.drop("v").collect()
    empty = m.stored(rows.drop("v").limit(0))
    assert empty.columns == ["a", "A", "b c", "n"] and empty.count() == 0


def test_replay_stores_events_small(spark, files_of, shared):
    files = migrations(files_of)
    tables, columns = replay(with_tables(files), ["db"])
    assert tables.count() == 60 and columns.count() == 60 * 9
    # 2,520 events whose paths alone have 80 bytes
    assert 0 < size(shared) < 100_000


def test_chain_audit_stores_events_small(spark, files_of, shared):
    found = audit_chains(migrations(files_of), ["db"])
    assert found.count() == 1
    assert 0 < size(shared) < 200_000


def test_report_stores_findings_small(spark, files_of, shared):
    texts = {
        f"services/{k:05}/src/main/resources/database/{k:04}.sql": f"CREATE TABLE wallet_{k} (id INT, card_pan TEXT, balance FLOAT);"
        for k in range(400)
    }
    audited = audited_files(files_of(texts, db="db_main"))
    findings = findings_of(audited, ["db"])
    assert findings.count() > 800
    report = json_report(
        findings,
        audit_summary(audited, SCHEMA_RULES, ["db"]),
        rule_results(findings, SCHEMA_RULES, ["db"], audited),
        Target("/data", "0", "2024-01-01T00:00:00+00:00", "2024-01-01T00:01:00+00:00"),
        ["db"],
    )
    stored = size(shared)
    lines, total = number_rows(report, [c for c in report.columns if c != "line"], "place")
    assert lines.count() == total
    # each finding repeats its path, title, reference and remediation
    texts_of_findings = findings.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    assert 0 < stored < texts_of_findings / 5
