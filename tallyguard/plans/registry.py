"""The registered queries: every operator over the given tables, whole tables and whole texts."""

from __future__ import annotations

import io
import posixpath
import tarfile
import uuid
import warnings
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.constants import CYBERSECURITY
from tallyguard.functions.attestation import target_fingerprint
from tallyguard.functions.ddl import prisma_tables, sql_tables
from tallyguard.functions.redaction import SecretPattern
from tallyguard.operators.attestation import attest, rule_claims
from tallyguard.operators.cors import cors_block_findings
from tallyguard.operators.extraction import (
    classify_columns,
    columns_of,
    constraints_of,
    tables_of,
    triggers_of,
    verify_invariants,
    with_tables,
)
from tallyguard.operators.findings import (
    by_severity,
    filter_findings,
    finding_details,
    first_per_rule,
    remediation_matrix,
    rules_per_table,
    sarif_results,
)
from tallyguard.operators.ledger import negative_entries, unbalanced_groups
from tallyguard.operators.materialise import materialise, shared_folder, stored
from tallyguard.operators.merkle import merkle_root, merkle_roots
from tallyguard.operators.numbering import number_rows, number_rows_by
from tallyguard.operators.redaction import explode_lines, redact, redaction_hits
from tallyguard.operators.remediation import (
    patched_files,
    patched_statements,
    remediation_statements,
    schema_trailer,
)
from tallyguard.operators.replay import (
    chain_facts,
    final_schema_findings,
    final_schema_path,
    final_schema_text,
    numbered_columns,
    replay,
)
from tallyguard.operators.summaries import (
    audit_summary,
    framework_summary,
    risk_summary,
    rule_results,
    tab_counts,
)
from tallyguard.plans.audit import audited_files, findings_of, line_findings
from tallyguard.plans.chains import audit_chains
from tallyguard.plans.corpora import (
    CONFIG_CORPUS,
    DDL_CORPUS,
    SECRET_DOCUMENTS,
    SEED_CORPUS,
    migration_corpus,
    spread,
)
from tallyguard.rules.catalog import EMAIL, LINE_RULES, NDPA_RULES, SCHEMA_RULES
from tallyguard.rules.model import TABLE, Rule, by_framework
from tallyguard.sinks.documents import (
    Target,
    document_keys,
    fixed_schema,
    json_report,
    remediation_script,
    sarif_document,
    write_findings,
)
from tallyguard.sources.archives import archive_members, rejected_archives
from tallyguard.sources.files import from_bytes, rejected_files, scan_directory, with_engine
from tallyguard.sources.listing import opened_system
from tallyguard.sources.ranges import scan_lines
from tallyguard.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def _ddl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_engine(DDL_CORPUS.frame(spark, sf_dir))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited_files(_ddl_files(spark, sf_dir))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of(_audited(spark, sf_dir))


def _seed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_engine(SEED_CORPUS.frame(spark, sf_dir))


# --- redaction --------------------------------------------------------------------------------


@_query
def redact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction_hits(_seed_files(spark, sf_dir), "raw_content", ["relative_path"])


@_query
def redact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_seed_files(spark, sf_dir), "raw_content").select(
        "relative_path", "redacted_text", "secret_count"
    )


@_query
def secrets_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: how many secrets of each category every nation's seed files hold."""
    hits = redaction_hits(_seed_files(spark, sf_dir), "raw_content", ["nation", "relative_path"])
    # counted per file first: the files of a nation are never gathered
    per_file = hits.groupBy("nation", "category", "relative_path").agg(
        F.count("*").alias("in_file")
    )
    return per_file.groupBy("nation", "category").agg(
        F.sum("in_file").alias("secrets"),
        F.count("*").alias("files"),
    )


@_query
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = SECRET_DOCUMENTS.frame(spark, sf_dir)
    return redact(documents, "content").select("doc_id", "redacted_text", "secret_count")


@_query
def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = SECRET_DOCUMENTS.frame(spark, sf_dir)
    return redaction_hits(documents, "content", ["doc_id"])


@_query
def redact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined pattern instead of the default ones, on every column of raw text."""
    email = [SecretPattern("E-mail addresses", "EMAIL", EMAIL)]
    documents = spread(read_table(spark, sf_dir, "documents"))
    return (
        redact(documents, "text", email)
        .filter("secret_count > 0")
        .select("doc_id", "redacted_text", "secret_count")
    )


@_query
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(read_table(spark, sf_dir, "documents"))
    lines = explode_lines(documents, "text", ["doc_id"])
    return lines.groupBy("doc_id").agg(
        F.max("line_number").alias("last_line"),
        F.sum(F.length("line")).alias("characters"),
    )


# --- line rules -------------------------------------------------------------------------------

_LINE_FINDING = [
    "rule_ord",
    "rule_id",
    "relative_path",
    "line_number",
    "sub_ord",
    "title",
    "description",
    "framework",
    "risk_tier",
    "remediation",
    "reference",
]


@_query
def config_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_findings(CONFIG_CORPUS.frame(spark, sf_dir)).select(*_LINE_FINDING)


@_query
def cors_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # blocks far smaller than a file, so that the state is carried across many of them
    lines = CONFIG_CORPUS.frame(spark, sf_dir)
    return cors_block_findings(lines, LINE_RULES, lines_per_block=256).select(
        "relative_path", "line_number", "description"
    )


@_query
def config_rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_results(line_findings(CONFIG_CORPUS.frame(spark, sf_dir)), LINE_RULES)


@_query
def seed_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(_seed_files(spark, sf_dir), "raw_content", ["relative_path"])
    credentials = [rule for rule in LINE_RULES if rule.rule_id == "CBN-001"]
    return line_findings(lines, credentials).select("relative_path", "line_number", "description")


@_query
def pii_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents and conversations with an e-mail address or an 11-digit number."""
    documents = spread(read_table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("documents/"), "doc_id").alias("relative_path"), "text"
    )
    turns = spread(read_table(spark, sf_dir, "conversations")).select(
        F.concat(F.lit("conversations/"), "conv_id", F.lit("/"), "turn").alias("relative_path"),
        "text",
    )
    lines = explode_lines(documents.unionByName(turns), "text", ["relative_path"])
    pii = [rule for rule in NDPA_RULES if rule.rule_id == "NDPA-003"]
    return line_findings(lines, pii).select("rule_id", "relative_path", "line_number")


@_query
def insecure_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), "page_id").alias("relative_path"),
        F.lit(1).cast("bigint").alias("line_number"),
        F.col("url").alias("line"),
    )
    transport = [rule for rule in NDPA_RULES if rule.rule_id == "NDPA-001"]
    return line_findings(urls, transport).select("relative_path", "description")


# --- sources and extraction ---------------------------------------------------------------------


@_query
def scan_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files in all kinds of places: which of them are read, and as what."""
    name = F.col("page_id").cast("string")
    case = F.col("page_id") % 10

    def at(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    path = (
        F.when(case == 0, at("a/", name, ".sql"))
        .when(case == 1, at("node_modules/", name, ".js"))
        .when(case == 2, at("src/build/", name, ".ts"))
        .when(case == 3, at("x/y/", name, ".SQL"))
        .when(case == 4, at("x/", name, ".html"))
        .when(case == 5, at("dir", name, "/.sql"))
        .when(case == 6, at("bad/", name, ".json"))
        .when(case == 7, at("conf/", name, ".Yaml"))
        .when(case == 8, at("mybuild/", name, ".tf"))
        .otherwise(at("p/", name, "/dist"))
    )
    content = (
        F.when(case == 6, F.concat(F.unhex(F.lit("C328")), F.col("html").cast("binary")))
        .when(case == 7, F.replace("html", F.lit(" "), F.lit("\r\n")).cast("binary"))
        .otherwise(F.col("html").cast("binary"))
    )
    raw = read_table(spark, sf_dir, "pages").select(
        path.alias("relative_path"), content.alias("content")
    )
    return with_engine(from_bytes(raw)).select(
        "relative_path", "engine_type", F.md5("raw_content").alias("content_md5")
    )


@contextmanager
def _folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder that driver and executors share, removed in the end."""
    root = f"{shared_folder(spark)}/{name}/{uuid.uuid4()}"
    try:
        yield root
    finally:
        system, folder = opened_system(root)
        system.delete_dir(folder)


@contextmanager
def _written(spark: SparkSession, rows: DataFrame) -> Iterator[str]:
    """The folder of files written from (relative_path, content) rows by the tasks that hold them."""

    with _folder(spark, "files") as root:

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, folder = opened_system(root)
            for batch in batches:
                for row in batch.to_pylist():
                    path = f"{folder}/{row['relative_path']}"
                    system.create_dir(posixpath.dirname(path))
                    with system.open_output_stream(path) as stream:
                        stream.write(row["content"])
                yield batch.select(["relative_path"])

        rows.mapInArrow(write, "relative_path string").write.format("noop").mode("overwrite").save()
        yield root


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under names of all kinds, hidden ones most of all; one in eight is not UTF-8, one is empty."""
    name, case = F.col("page_id").cast("string"), F.col("page_id") % 8

    def at(before: str, after: str) -> Column:
        return F.concat(F.lit(before), name, F.lit(after))

    path = (
        F.when(case == 0, at("a/_", ".sql"))
        .when(case == 1, at(".", ".json"))
        .when(case == 2, at("node_modules/_", ".sql"))
        .when(case == 3, at("_x/.y/", ".YML"))
        .when(case == 4, at("bad/.", ".sql"))
        .when(case == 5, at("plain/", ".ts"))
        .when(case == 6, at("x/_", ".html"))
        .otherwise(at("empty/_", ".tf"))
    )
    content = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    broken = F.concat(content, F.unhex(F.lit("C328")))
    return read_table(spark, sf_dir, "pages").select(
        path.alias("relative_path"),
        F.when(case == 4, broken).when(case == 7, F.lit(b"")).otherwise(content).alias("content"),
    )


@_query
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory tree with hidden names, scanned whole."""
    with _written(spark, _page_files(spark, sf_dir)) as root:
        scanned = scan_directory(spark, root)
        return materialise(
            scanned.select("relative_path", "engine_type", F.md5("raw_content").alias("content_md5"))
        )


@_query
def scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that scan leaves out, and why; files above 3,000 bytes are too large here."""
    with _written(spark, _page_files(spark, sf_dir)) as root:
        return materialise(rejected_files(spark, root, most_bytes=3000))


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("docs/_"), "doc_id", F.lit(".yaml"))
    return read_table(spark, sf_dir, "documents").select(
        path.alias("relative_path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")
    )


# far smaller than a file, so that most lines lie beside or across a border
_RANGE = 700


@_query
def range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, read by ranges: the last line and the characters of each."""
    with _written(spark, _document_files(spark, sf_dir)) as root:
        lines, _ = scan_lines(spark, root, _RANGE)
        return materialise(
            lines.groupBy("relative_path").agg(
                F.max("line_number").alias("last_line"),
                F.count("*").alias("lines"),
                F.sum(F.length("line")).alias("characters"),
            )
        )


@_query
def range_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line rule over the lines of those ranges."""
    pii = [rule for rule in NDPA_RULES if rule.rule_id == "NDPA-003"]
    with _written(spark, _document_files(spark, sf_dir)) as root:
        lines, _ = scan_lines(spark, root, _RANGE)
        return materialise(line_findings(lines, pii).select("rule_id", "relative_path", "line_number"))


@_query
def engine_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ddl_files(spark, sf_dir).groupBy("engine_type").agg(F.count("*").alias("files"))


@_query
def ddl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_of(with_tables(_ddl_files(spark, sf_dir))).select(
        "relative_path",
        "table_ord",
        "name",
        "is_ledger_table",
        F.size("columns").alias("column_count"),
        F.size("constraints").alias("constraint_count"),
        F.size("triggers").alias("trigger_count"),
    )


@_query
def fallback_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text read as SQL, and where that finds nothing, as a Prisma schema; no engine type is used."""
    unknown = _ddl_files(spark, sf_dir).withColumn("engine_type", F.lit(""))
    parsed = with_tables(unknown, extractors=[sql_tables, prisma_tables])
    return tables_of(parsed).select(
        "relative_path", "table_ord", "name", F.size("columns").alias("column_count")
    )


@_query
def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns_of(with_tables(_ddl_files(spark, sf_dir))).withColumn(
        "references", _text("references")
    )


@_query
def ddl_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints_of(with_tables(_ddl_files(spark, sf_dir)))


@_query
def ddl_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers_of(with_tables(_ddl_files(spark, sf_dir)))


@_query
def column_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = columns_of(with_tables(_ddl_files(spark, sf_dir)))
    return classify_columns(columns).select(
        "relative_path",
        "table_ord",
        "col_ord",
        "name",
        "classification",
        "is_violation",
        "risk_reason",
        "remediation_hint",
    )


@_query
def invariant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = tables_of(with_tables(_ddl_files(spark, sf_dir)))
    return verify_invariants(tables).select(
        "relative_path", "table_ord", "name", "is_sound", "proof_expression", "counter_example"
    )


def _pack(bucket: pd.DataFrame) -> pd.DataFrame:
    """One archive out of the documents of a bucket (50 at most)."""
    number = int(bucket["bucket"].iloc[0])
    members = []
    for doc_id, text in zip(bucket["doc_id"], bucket["text"], strict=True):
        folder = "node_modules" if doc_id % 3 == 0 else "./docs" if doc_id % 3 == 1 else "a/../docs"
        members.append((f"{folder}/{doc_id}.sql", text.encode()))
    if number % 7 == 3:
        members.append(("x/../../evil.sql", b"select 1"))
    data = io.BytesIO()
    if number % 2 == 0:
        name = f"{number}.zip"
        with warnings.catch_warnings(), zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            warnings.simplefilter("ignore")
            if number % 8 == 4:
                # a path that comes again: the last one counts
                archive.writestr(members[0][0], b"an earlier version")
            for path, content in members:
                archive.writestr(path, content)
    else:
        name = f"{number}.TAR.GZ"
        with tarfile.open(fileobj=data, mode="w:gz") as archive:
            for path, content in members:
                info = tarfile.TarInfo(path)
                info.size = len(content)
                archive.addfile(info, io.BytesIO(content))
    packed = data.getvalue()
    if number % 13 == 6:
        if number % 2 == 0:
            # another checksum in the directory entry of the first member
            at = packed.index(b"PK\x01\x02") + 16
            packed = packed[:at] + bytes(b ^ 255 for b in packed[at : at + 4]) + packed[at + 4 :]
        else:
            packed = packed[: len(packed) // 2]
    if number % 11 == 5:
        name = f"{number}.rar"
    return pd.DataFrame({"archive": [name], "content": [packed]})


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 50).alias("bucket"), "doc_id", "text"
    )
    packed = documents.groupBy("bucket").applyInPandas(_pack, "archive string, content binary")
    return packed.withColumn("length", F.length("content").cast("bigint"))


@_query
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_members(_archives(spark, sf_dir)).select(
        "archive", "relative_path", F.md5("content").alias("content_md5")
    )


@_query
def archive_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_archives(_archives(spark, sf_dir))


# --- schema rules and summaries -----------------------------------------------------------------


@_query
def schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select(
        "rule_ord",
        "relative_path",
        "table_ord",
        "col_ord",
        "rule_id",
        "title",
        "description",
        "framework",
        "risk_tier",
        "file_path",
        _text("table_name"),
        _text("column_name"),
        "code_snippet",
        "remediation",
        "reference",
    )


@_query
def findings_of_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = by_framework(SCHEMA_RULES, CYBERSECURITY)
    audited = audited_files(_ddl_files(spark, sf_dir), chosen)
    return findings_of(audited).select("rule_ord", "rule_id", "relative_path", "table_ord")


@_query
def custom_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the user: tables of five columns and more that refer to another table."""
    rule = Rule(
        "USER-001",
        "References other tables",
        "House rules",
        "LOW",
        TABLE,
        lambda s: F.exists(s.table["columns"], lambda c: c["is_foreign_key"])
        & (F.size(s.table["columns"]) >= 5),
        lambda s: F.concat(
            s.table["name"],
            F.lit(" has "),
            F.size(s.table["columns"]).cast("string"),
            F.lit(" columns"),
        ),
    )
    audited = audited_files(_ddl_files(spark, sf_dir), [rule])
    return findings_of(audited).select(
        "rule_id", "relative_path", "table_name", "description", "risk_tier"
    )


@_query
def schema_rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_results(_findings(spark, sf_dir), SCHEMA_RULES)


@_query
def findings_per_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_summary(_findings(spark, sf_dir))


@_query
def findings_per_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framework_summary(_findings(spark, sf_dir))


@_query
def findings_per_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab_counts(_findings(spark, sf_dir))


@_query
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_summary(_audited(spark, sf_dir), SCHEMA_RULES)


@_query
def audit_totals_per_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_summary(_audited(spark, sf_dir), SCHEMA_RULES, ["db"])


# --- queries over findings ----------------------------------------------------------------------


@_query
def findings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_findings(_findings(spark, sf_dir), "CRITICAL", "WALLET")
    return found.select("rule_id", "relative_path", _text("table_name"), _text("column_name"))


@_query
def findings_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_details(_findings(spark, sf_dir))


@_query
def findings_remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation_matrix(_findings(spark, sf_dir))


@_query
def findings_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif_results(_findings(spark, sf_dir)).select(
        "rule_id", "level", "message", "uri", "start_line"
    )


@_query
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest findings first, with the place of each, so that the order counts."""
    placed, _ = number_rows(_findings(spark, sf_dir), by_severity(), "place")
    return placed.select("place", "risk_tier", "rule_id", "relative_path", "table_ord", "col_ord")


@_query
def first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_rule(materialise(_findings(spark, sf_dir))).select(
        "rule_id", "title", "relative_path", "table_ord", "col_ord", "description"
    )


@_query
def broken_rules_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_per_table(_findings(spark, sf_dir)).select(
        "table_name", F.array_join("rule_ids", ",").alias("rule_ids")
    )


# --- ledgers ------------------------------------------------------------------------------------


@_query
def unbalanced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose total (debit) differs from the sum of their line items (credit)."""
    money = "decimal(18,2)"
    zero = F.lit(0).cast(money)
    debits = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry"),
        F.col("o_totalprice").cast(money).alias("debit"),
        zero.alias("credit"),
    )
    credits = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entry"),
        zero.alias("debit"),
        F.col("l_extendedprice").cast(money).alias("credit"),
    )
    groups = unbalanced_groups(debits.unionByName(credits), ["entry"])
    return groups.select(
        "entry",
        F.col("total_debit").cast("double").alias("total_debit"),
        F.col("total_credit").cast("double").alias("total_credit"),
    )


@_query
def negative_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("debit"), F.lit(0.0).alias("credit")
    )
    return negative_entries(entries).select("c_custkey", "debit")


# --- migrations ---------------------------------------------------------------------------------


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tables(with_engine(migration_corpus(spark, sf_dir)))


@_query
def final_schema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, _ = replay(_chain(spark, sf_dir), ["db"])
    return tables.select(
        "db",
        "table_key",
        "name",
        "is_ledger_table",
        F.col("first_seq.relative_path").alias("first_file"),
        F.col("last_seq.relative_path").alias("last_file"),
    )


@_query
def final_schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, columns = replay(_chain(spark, sf_dir), ["db"])
    return numbered_columns(columns, ["db"]).select(
        "db", "table_key", "col_ord", "name", "data_type", "is_nullable", "is_primary_key"
    )


@_query
def final_schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _chain(spark, sf_dir)
    tables, columns = replay(chain, ["db"])
    found = final_schema_findings(chain, tables, columns, SCHEMA_RULES, ["db"])
    return found.select(
        "db", "rule_ord", "rule_id", "relative_path", _text("table_name"), _text("column_name")
    )


@_query
def final_schema_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_schema_text(with_engine(migration_corpus(spark, sf_dir)), ["db"])


@_query
def final_schema_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under which name the replayed schema of every database goes, one without files included."""
    files = with_engine(migration_corpus(spark, sf_dir))
    databases = files.select("db").distinct().union(spark.createDataFrame([("db_empty",)], "db string"))
    return final_schema_path(databases, files, ["db"])


@_query
def audit_totals_with_final_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_chains(with_engine(migration_corpus(spark, sf_dir)), ["db"])


@_query
def migration_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_facts(with_engine(migration_corpus(spark, sf_dir)), ["db"]).select(
        "db", "file_count", "path", "engine_type", "has_cascade_text", "secret_count"
    )


# --- remediation --------------------------------------------------------------------------------


@_query
def remediation_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation_statements(_findings(spark, sf_dir)).select(
        "rule_ord", "relative_path", "table_ord", "col_ord", "stmt_ord", "table_name", "statement"
    )


@_query
def patched_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _ddl_files(spark, sf_dir)
    findings = findings_of(audited_files(files), ["db"])
    return patched_statements(files, findings, ["db"]).select(
        "db", "table_name", "relative_path", "patched_ddl"
    )


@_query
def patched_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _ddl_files(spark, sf_dir)
    findings = findings_of(audited_files(files), ["db"])
    return patched_files(files, findings, ["db"])


@_query
def guard_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = findings_of(_audited(spark, sf_dir), ["db"])
    return schema_trailer(findings, ["db"]).select("db", "table_name", "statement")


@_query
def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings as stored for dashboards, read back."""
    with _folder(spark, "findings") as path:
        write_findings(_findings(spark, sf_dir), path)
        return materialise(
            spark.read.parquet(path).select(
                "rule_id",
                "risk_tier",
                "file_path",
                _text("table_name"),
                _text("column_name"),
                "description",
                "reference",
            )
        )


_TARGET = Target(
    "/data/schemas", "0123456789abcdef", "2024-01-01T00:00:00+00:00", "2024-01-01T00:01:00+00:00"
)


def _placed(document: DataFrame, by: list[str]) -> DataFrame:
    """The lines of every document with their places, so that the order counts."""
    return number_rows_by(document, by, document_keys(document, by), "place")[0].select(*by, "place", "line")


@_query
def remediation_script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remediation.sql of the whole corpus."""
    script = remediation_script(_findings(spark, sf_dir), _TARGET)
    return number_rows(script, document_keys(script), "place")[0].select("place", "line")


@_query
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report of every database."""
    audited = stored(_audited(spark, sf_dir).select("db", "tables", "redacted", "findings"))
    findings = findings_of(audited, ["db"])
    results = rule_results(findings, SCHEMA_RULES, ["db"], audited)
    report = json_report(findings, audit_summary(audited, SCHEMA_RULES, ["db"]), results, _TARGET, ["db"])
    return _placed(report, ["db"])


@_query
def sarif_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SARIF log of every database."""
    findings = findings_of(_audited(spark, sf_dir), ["db"])
    return _placed(sarif_document(findings, ["db"], _ddl_files(spark, sf_dir)), ["db"])


@_query
def fixed_schema_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema.fixed.sql of every database."""
    files = _ddl_files(spark, sf_dir)
    return _placed(fixed_schema(files, findings_of(audited_files(files), ["db"]), ["db"]), ["db"])


# --- attestation --------------------------------------------------------------------------------


@_query
def orders_merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat_ws("|", F.col("o_orderkey"), F.col("o_orderstatus")).alias("leaf")
    )
    return merkle_root(orders, ["o_orderkey"], "leaf")


@_query
def nation_merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root over the orders of every nation; a third of the orders count as one nation's."""
    owners = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    leaves = orders.select(
        F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("c_nationkey")).alias("nation"),
        "o_orderkey",
        F.concat_ws("|", F.col("o_orderkey"), F.col("o_orderstatus")).alias("leaf"),
    )
    # short runs, so that several passes are needed
    return merkle_roots(leaves, ["nation"], ["o_orderkey"], "leaf", levels_per_pass=3)


@_query
def schema_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_claims(rule_results(_findings(spark, sf_dir), SCHEMA_RULES))


@_query
def attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = attest(
        _audited(spark, sf_dir),
        SCHEMA_RULES,
        fingerprint="0123456789abcdef",
        completed_at="2024-01-01T00:00:00+00:00",
        salt="AUDIT_V1",
    )
    return record.drop("proof_signature")


@_query
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select(
        "page_id",
        target_fingerprint(
            F.col("url"), F.lit("2024-01-01T00:00:00+00:00")
        ).alias("fingerprint"),
    )
