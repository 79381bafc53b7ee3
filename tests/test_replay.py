"""Replay of chains whose result is known, numbering, and Merkle roots."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyguard.operators.extraction import with_tables
from tallyguard.operators.merkle import EMPTY_ROOT, merkle_root, root_of_array
from tallyguard.operators.numbering import number_rows
from tallyguard.operators.replay import (
    chain_facts,
    final_columns,
    final_schema_findings,
    final_schema_text,
    final_tables,
    numbered_columns,
    replay,
    schema_events,
    split_definitions,
)
from tallyguard.operators.summaries import audit_summary, audit_summary_with_final_schema
from tallyguard.plans import chains as chains_plan
from tallyguard.plans.audit import audited_files
from tallyguard.rules.catalog import SCHEMA_RULES
from tallyguard.sources.files import with_engine


class Chain:
    """Migration files of one database, written together with the schema that they lead to.

    Within a file all CREATE statements count first, then what is added, then what is dropped.
    """

    def __init__(self, rng: random.Random):
        self.files, self.tables = {}, {}
        for n in range(rng.randint(1, 9)):
            steps = [self._step(rng) for _ in range(rng.randint(1, 4))]
            self.files[f"{n:03d}.sql"] = "\n".join(text for *_, text in steps)
            for phase in ("create", "add", "drop"):
                for kind, table, content, _ in steps:
                    if kind == phase:
                        getattr(self, phase)(table, content)

    @staticmethod
    def _step(rng: random.Random) -> tuple:
        table, column, kind = rng.choice(["t", "T", "ledger"]), rng.choice(["a", "B", "b", "c"]), f"T{rng.randint(0, 9)}"
        # a column twice in one body: both are kept as written
        twice = [(column, "INT"), ("z", "TEXT"), (column.upper(), "DATE")]
        return rng.choice(
            [
                ("create", table, twice, f"CREATE TABLE {table} ({column} INT, z TEXT NOT NULL, {column.upper()} DATE);"),
                ("create", table, [("a", "INT")], f"CREATE TABLE {table} (a INT);"),
                ("add", table, (column, kind), f"ALTER TABLE {table} ADD COLUMN {column} {kind};"),
                ("add", table, (column, kind), f'alter table "{table}" add "{column}" {kind}, add q X;'),
                ("drop", table, column, f"ALTER TABLE {table} DROP COLUMN {column};"),
                ("drop", table, column, f"ALTER TABLE `{table}` DROP {column};"),
            ]
        )

    def create(self, table: str, columns: list[tuple[str, str]]) -> None:
        self.tables[table.lower()] = list(columns)

    def add(self, table: str, column: tuple[str, str]) -> None:
        columns = self.tables.get(table.lower(), [])
        names = [name.lower() for name, _ in columns]
        if column[0].lower() in names:
            at = names.index(column[0].lower())
            columns[at] = (columns[at][0], column[1])
        else:
            columns.append(column)

    def drop(self, table: str, column: str) -> None:
        columns = self.tables.get(table.lower(), [])
        columns[:] = [c for c in columns if c[0].lower() != column.lower()]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(23)
    return {f"db{i}": Chain(rng) for i in range(40)}


@pytest.fixture(scope="module")
def chains(made):
    return {db: chain.files for db, chain in made.items()}


@pytest.fixture(scope="module")
def parsed(spark, chains):
    from tallyguard.sources.files import with_engine

    rows = [(db, path, text) for db, files in chains.items() for path, text in files.items()]
    return with_tables(with_engine(spark.createDataFrame(rows, "db string, relative_path string, content string")))


def test_replay_gives_the_known_schema(parsed, made):
    tables, columns = replay(parsed, ["db"])
    got = {(r["db"], r["table_key"]): [] for r in tables.collect()}
    rows = numbered_columns(columns, ["db"]).orderBy("db", "table_key", "col_ord").collect()
    for r in rows:
        got[r["db"], r["table_key"]].append((r["name"], r["data_type"]))
        assert r["col_ord"] == len(got[r["db"], r["table_key"]]) - 1
    expected = {(db, t): cols for db, chain in made.items() for t, cols in chain.tables.items()}
    assert got == expected


def test_final_schema_audit(parsed, chains, made):
    tables, columns = replay(parsed, ["db"])
    found = final_schema_findings(parsed, tables, columns, SCHEMA_RULES, ["db"]).collect()
    assert {r["relative_path"] for r in found} == {"reconstituted_final_schema.sql"}
    multi = {db for db, files in chains.items() if len(files) > 1}
    ledgers = {db for db in multi if "ledger" in made[db].tables}
    for rule in ("FIN-IMM-001", "FIN-IMM-002", "FIN-CBN-001"):
        assert {r["db"] for r in found if r["rule_id"] == rule} == ledgers
    assert {r["db"] for r in chain_facts(parsed, ["db"]).collect()} == multi


def test_totals_with_the_final_schema(parsed, made):
    audited = audited_files(parsed)
    tables, columns = replay(parsed, ["db"])
    found = final_schema_findings(parsed, tables, columns, SCHEMA_RULES, ["db"])
    whole = audit_summary_with_final_schema(
        audited, chain_facts(parsed, ["db"]), tables, found, SCHEMA_RULES, ["db"]
    )
    files = {r["db"]: r for r in audit_summary(audited, SCHEMA_RULES, ["db"]).collect()}
    per_db = {r["db"]: r["count"] for r in found.groupBy("db").count().collect()}
    for row in whole.collect():
        alone, chain = files[row["db"]], made[row["db"]]
        several = len(chain.files) > 1
        assert row["total_files_scanned"] == len(chain.files) + several
        assert row["total_tables_audited"] == alone["total_tables_audited"] + several * len(chain.tables)
        assert row["total_findings"] == alone["total_findings"] + per_db.get(row["db"], 0)
        assert row["compliance_score"] <= alone["compliance_score"]


def test_chains_from_one_reading(spark, parsed, monkeypatch):
    files = parsed.drop("tables")
    tables, columns = replay(parsed, ["db"])
    found = final_schema_findings(parsed, tables, columns, SCHEMA_RULES, ["db"])
    wanted = audit_summary_with_final_schema(
        audited_files(files), chain_facts(parsed, ["db"]), tables, found, SCHEMA_RULES, ["db"]
    )
    stored = []
    keep = chains_plan.materialise
    monkeypatch.setattr(chains_plan, "materialise", lambda df: stored.append(df) or keep(df))
    got = chains_plan.audit_chains(files, ["db"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.select(got.columns).collect()))
    # one reading of the texts, each of which is searched once per pattern
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 20
    assert "raw_content" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_column_with_most_events_spreads(spark):
    rows = [("db", f"m{i:05}.sql", f"ALTER TABLE ledger ADD COLUMN hot INT{i};", "big") for i in range(4000)]
    rows += [("db", f"n{i:05}.sql", f"ALTER TABLE ledger ADD COLUMN c{i} INT;", "big") for i in range(300)]
    rows += [("db", "a.sql", "CREATE TABLE ledger (hot TEXT, cold TEXT);", "big")]
    rows += [("db", "m02000_.sql", "ALTER TABLE ledger DROP COLUMN hot;", "big")]
    frame = spark.createDataFrame(rows, "db string, relative_path string, content string, x string").repartition(8)
    events = schema_events(with_tables(with_engine(frame)), ["db"])
    tables = final_tables(events, ["db"])
    hot, others = split_definitions(events, tables, ["db"], hot_columns=20)
    counts = [r["count"] for r in hot.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(counts) == 1999 and len(counts) == 8 and max(counts) < 400
    assert others.count() == 301
    for share in (1, 20, 10_000):
        columns = final_columns(events, tables, ["db"], share)
        ranked = numbered_columns(columns, ["db"]).orderBy("col_ord").collect()
        assert [r["name"] for r in ranked] == ["cold", "hot", *[f"c{i}" for i in range(300)]]
        assert ranked[1]["data_type"] == "INT3999"


def test_joined_text(parsed, chains):
    rows = final_schema_text(parsed, ["db"]).orderBy("db", "relative_path", "at").collect()
    for db, files in chains.items():
        joined = "\n".join(r["line"] for r in rows if r["db"] == db)
        assert joined == "\n\n".join(files[p] for p in sorted(files))


def test_numbering(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    numbered, total = number_rows(frame, ["k"])
    assert total == 5000
    assert numbered.filter("k <> idx").count() == 0


def _root(texts: list[str]) -> str:
    level = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 33, 100])
def test_merkle(spark, n):
    frame = spark.range(n).select("id", F.concat(F.lit("claim "), "id").alias("c"))
    expected = _root([f"claim {i}" for i in range(n)])
    for levels in (1, 2, 10):
        [row] = merkle_root(frame, ["id"], "c", levels).collect()
        assert (row["leaf_count"], row["merkle_root"]) == (n, expected)
    array = frame.agg(F.array_sort(F.collect_list(F.struct("id", "c"))).alias("a"))
    assert array.select(root_of_array(F.transform("a", lambda x: x["c"]), n)).first()[0] == expected


def test_merkle_of_nothing(spark):
    [row] = merkle_root(spark.range(0).select("id", F.lit("x").alias("c")), ["id"], "c").collect()
    assert (row["leaf_count"], row["merkle_root"]) == (0, EMPTY_ROOT)
