"""From findings to SQL: remediation statements and a rewritten schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.text import SPACE, explode_found, let
from tallyguard.operators.findings import rules_per_table
from tallyguard.operators.materialise import materialise
from tallyguard.rules.engine import ORDER_KEY

# The statements, with {t} for the table.
_ADD_CHECK = (
    "ALTER TABLE {t} ADD CONSTRAINT chk_{t}_balance_non_negative"
    " CHECK (debit >= 0 AND credit >= 0);\n"
)
_CASCADE_WARNING = "-- WARNING: Remove ON DELETE CASCADE from {t} foreign keys.\n"
_ADD_ENCRYPTED = "ALTER TABLE {t} ADD COLUMN bvn_encrypted BYTEA;\n"
_CARD_NOTE = "-- Replace raw Card PAN/CVV on {t} with gateway tokens.\n"
_GUARD_FUNCTION = """CREATE OR REPLACE FUNCTION prevent_{t}_modification()
RETURNS TRIGGER AS $$
BEGIN
    RAISE EXCEPTION 'Financial ledger tables are immutable. UPDATE/DELETE operations prohibited.';
END;
$$ LANGUAGE plpgsql;
"""
_GUARD_TRIGGER = """CREATE TRIGGER trg_prevent_mod_{t}
BEFORE UPDATE OR DELETE ON {t}
FOR EACH ROW EXECUTE FUNCTION prevent_{t}_modification();
"""
_ADD_CREATED = (
    "ALTER TABLE {t} ADD COLUMN IF NOT EXISTS created_at TIMESTAMP WITH TIME ZONE"
    " DEFAULT CURRENT_TIMESTAMP;\n"
)
_AUDIT_LOG = """CREATE TABLE IF NOT EXISTS audit_log (
    id BIGSERIAL PRIMARY KEY,
    table_name VARCHAR(100) NOT NULL,
    operation VARCHAR(20) NOT NULL,
    record_id VARCHAR(100),
    old_data JSONB,
    new_data JSONB,
    performed_at TIMESTAMP WITH TIME ZONE DEFAULT CURRENT_TIMESTAMP
);"""
STATEMENTS: dict[str, list[str]] = {
    "FIN-DE-001": [_ADD_CHECK],
    "FIN-DE-002": [_CASCADE_WARNING],
    "FIN-PII-001": [_ADD_ENCRYPTED],
    "FIN-PII-002": [_CARD_NOTE],
    "FIN-IMM-001": [_GUARD_FUNCTION, _GUARD_TRIGGER],
    "FIN-IMM-002": [_ADD_CREATED],
    "FIN-CBN-001": [_AUDIT_LOG + "\n"],
}
_CREATED_COLUMN = ",\n    created_at TIMESTAMP WITH TIME ZONE DEFAULT CURRENT_TIMESTAMP"
_TRAILER_GUARD = """
CREATE OR REPLACE FUNCTION prevent_{t}_modification()
RETURNS TRIGGER AS $$
BEGIN
    RAISE EXCEPTION 'Financial ledger tables are immutable. UPDATE/DELETE prohibited.';
END;
$$ LANGUAGE plpgsql;

CREATE TRIGGER trg_prevent_mod_{t}
BEFORE UPDATE OR DELETE ON {t}
FOR EACH ROW EXECUTE FUNCTION prevent_{t}_modification();"""
DEFAULT_TABLE = "target_table"


def _fill(template: str, table: Column) -> Column:
    pieces = template.split("{t}")
    parts: list[Column] = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [table, F.lit(piece)]
    return F.concat(*parts)


def _named(table_name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(table_name), F.lit("")), F.lit(default))


def remediation_statements(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, order key, rule_id, table_name, stmt_ord, statement), in the order of the script.

    Every finding gives two comment lines and, by rule, further statements. Findings of other
    rules only get their comments.
    """
    table = _named("table_name", DEFAULT_TABLE)
    comments = [
        F.concat(F.lit("-- ["), F.col("rule_id"), F.lit("] "), F.col("title")),
        F.concat(
            F.lit("-- Risk: "),
            F.col("risk_tier"),
            F.lit(" | Table: "),
            _named("table_name", "N/A"),
        ),
    ]
    statements = F.array(*comments)
    for rule_id, templates in STATEMENTS.items():
        statements = F.when(
            F.col("rule_id") == rule_id,
            F.array(*comments, *[_fill(t, table) for t in templates]),
        ).otherwise(statements)
    return findings.select(
        *by,
        *ORDER_KEY,
        "rule_id",
        table.alias("table_name"),
        F.posexplode(statements).alias("stmt_ord", "statement"),
    )


# --- rewriting the CREATE TABLE statements ---------------------------------------------------
#
# A statement runs from its head to the next ");". Texts are cut at their statements once, and the
# rewritten ones are put in their places from left to right, so the work is linear in the text. What
# is shuffled to find the patches are names, digests and rule ids.
_FLAGS = "(?isu)"
_HEAD = rf"CREATE{SPACE}+TABLE{SPACE}+([a-zA-Z0-9_\"'`\.]+){SPACE}*\("
# A mark in front of and behind each statement; a text that has this character already gets it escaped.
_SIGN = "\ue000"
_ESCAPED, _MARK = _SIGN + "a", _SIGN + "b"


def _cut(raw: Column) -> Column:
    """struct(pieces, rest): every second piece is a statement, and ``rest`` is what follows the last
    ");". A head inside of a statement belongs to its piece."""

    def marked(escaped: Column) -> Column:
        return let(
            F.regexp_extract(escaped, r"(?s)\A(.*\);)", 1),
            lambda ended: F.struct(
                F.split(
                    F.regexp_replace(ended, rf"{_FLAGS}({_HEAD}.*?\);)", f"{_MARK}$1{_MARK}"), _MARK, -1
                ).alias("pieces"),
                F.substr(escaped, F.length(ended) + 1).alias("rest"),
            ),
        )

    return let(F.replace(raw, F.lit(_SIGN), F.lit(_ESCAPED)), marked)


def _restored(text: Column) -> Column:
    return F.replace(text, F.lit(_ESCAPED), F.lit(_SIGN))


def _chunks(piece: Column) -> Column:
    """A piece cut in front of each head in it; the statement of a head goes on to the end."""
    return F.split(piece, rf"{_FLAGS}(?={_HEAD})", -1)


def _from(chunks: Column, position: Column) -> Column:
    return F.array_join(F.slice(chunks, position + 1, F.size(chunks)), "")


def _is_sql(files: DataFrame) -> DataFrame:
    return files.filter(F.lower("relative_path").rlike(r"[^/]\.sql\z"))


def create_statements(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, relative_path, piece, head, table_key, text_key): the plain CREATE TABLE statements.

    ``piece`` and ``head`` give the place of a statement, ``text_key`` is the digest of its text.
    """
    raw = F.col("raw_content")

    def of_piece(piece: Column, number: Column) -> Column:
        def of_chunk(chunks: Column) -> Column:
            return F.transform(
                chunks,
                lambda chunk, head: F.struct(
                    number.alias("piece"),
                    head.alias("head"),
                    F.lower(F.regexp_extract(chunk, _FLAGS + _HEAD, 1)).alias("table_key"),
                    F.sha2(_from(chunks, head), 256).alias("text_key"),
                ),
            )

        return let(_chunks(piece), of_chunk)

    def of_pieces(pieces: Column) -> Column:
        last = F.floor(F.size(pieces) / 2).cast("int") - 1
        numbers = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(numbers, lambda n: of_piece(F.get(pieces, 2 * n + 1), n)))

    found = F.when(F.lower(raw).contains("create"), let(_cut(raw)["pieces"], of_pieces))
    return (
        _is_sql(files)
        .select(*by, "relative_path", explode_found(found).alias("s"))
        .filter(F.col("s").isNotNull())
        .select(*by, "relative_path", "s.*")
    )


def _patched(table: Column, body: Column, rule_ids: Column) -> Column:
    """The rewritten statement for a table that breaks ``rule_ids``."""
    breaks = lambda rule_id: F.array_contains(rule_ids, rule_id)
    encrypted = body
    for name in ("bvn", "nin"):
        encrypted = F.regexp_replace(
            encrypted,
            rf"(?iu)(?<![\p{{L}}\p{{N}}_]){name}{SPACE}+VARCHAR\(\p{{Nd}}+\)",
            f"{name}_encrypted BYTEA",
        )
    step1 = F.when(breaks("FIN-PII-001"), encrypted).otherwise(body)

    def add_created(text: Column) -> Column:
        missing = ~F.lower(text).contains("created_at")
        return F.when(
            breaks("FIN-IMM-002") & missing, F.concat(text, F.lit(_CREATED_COLUMN))
        ).otherwise(text)

    def add_check(text: Column) -> Column:
        missing = ~F.upper(text).contains("CHECK")
        clause = F.concat(
            F.lit(",\n    CONSTRAINT chk_"),
            table,
            F.lit("_balance CHECK (debit >= 0 AND credit >= 0)"),
        )
        return F.when(breaks("FIN-DE-001") & missing, F.concat(text, clause)).otherwise(text)

    final_body = let(let(step1, add_created), add_check)
    return F.concat(F.lit("CREATE TABLE "), table, F.lit(" ("), final_body, F.lit("\n);"))


def _patches(files: DataFrame, findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, relative_path, piece, head, table_key, table_name, rule_ids, is_first): the statements
    that are rewritten, by place.

    Per table with findings, the first statement in file order is chosen; it is rewritten wherever the
    same text occurs in its database.
    """
    broken = (
        rules_per_table(findings, list(by))
        .withColumn("table_key", F.lower("table_name"))
        .groupBy(*by, "table_key")
        .agg(
            F.min("table_name").alias("table_name"),
            F.array_distinct(F.flatten(F.collect_set("rule_ids"))).alias("rule_ids"),
        )
    )
    statements = materialise(create_statements(files, by))
    place = F.struct("relative_path", "piece", "head")
    first = statements.groupBy(*by, "table_key").agg(
        F.min_by("text_key", place).alias("text_key"), F.min(place).alias("first")
    )
    # one row per (database, table), stored: it holds the whole audit, and the join below can then
    # split a frequent table name
    chosen = materialise(broken.join(first, [*by, "table_key"]))
    return statements.join(chosen, [*by, "table_key", "text_key"]).select(
        *by,
        "relative_path",
        "piece",
        "head",
        "table_key",
        "table_name",
        "rule_ids",
        (F.col("first") == place).alias("is_first"),
    )


def _statement_patched(statement: Column, patch: Column) -> Column:
    """A statement, of which nothing precedes the head, rewritten."""
    head = F.regexp_extract(statement, rf"{_FLAGS}\A{_HEAD}", 0)
    body = F.substr(statement, F.length(head) + 1, F.length(statement) - F.length(head) - 2)
    return let(body, lambda b: _patched(patch["table_name"], b, patch["rule_ids"]))


def patched_statements(
    files: DataFrame, findings: DataFrame, by: Sequence[str]
) -> DataFrame:
    """(by, table_key, table_name, relative_path, patched_ddl).

    One row per table with findings whose CREATE TABLE is found in the .sql files of its database;
    the first statement in file order is the one that is rewritten.
    """
    of_file = (
        _patches(files, findings, by)
        .filter("is_first")
        .groupBy(*by, "relative_path")
        .agg(F.collect_list(F.struct("piece", "head", "table_key", "table_name", "rule_ids")).alias("patches"))
    )

    def rewrite(pieces: Column) -> Column:
        def one(patch: Column) -> Column:
            statement = _from(_chunks(F.get(pieces, 2 * patch["piece"] + 1)), patch["head"])
            return F.struct(
                patch["table_key"].alias("table_key"),
                patch["table_name"].alias("table_name"),
                _restored(let(statement, lambda s: _statement_patched(s, patch))).alias("patched_ddl"),
            )

        return F.transform("patches", one)

    rewritten = let(_cut(F.col("raw_content"))["pieces"], rewrite)
    return (
        _is_sql(files)
        .select(*by, "relative_path", "raw_content")
        .join(of_file, [*by, "relative_path"])
        .select(*by, "relative_path", explode_found(rewritten).alias("p"))
        .select(*by, "p.table_key", "p.table_name", "relative_path", "p.patched_ddl")
    )


def patched_files(
    files: DataFrame, findings: DataFrame, by: Sequence[str], keep: str = "raw_content"
) -> DataFrame:
    """(by, relative_path, patched_content): every .sql file with its statements rewritten.

    A statement is rewritten wherever the same text occurs. Where one is cut short by the head of
    another, so that both end at the same place, the inner one is rewritten first.
    """
    places = _patches(files, findings, by)
    # the patches of a file by piece and head, each at its index: never more than its statements
    of_piece = places.groupBy(*by, "relative_path", "piece").agg(
        F.collect_list(F.struct("head", "table_name", "rule_ids")).alias("patches")
    )
    of_file = of_piece.groupBy(*by, "relative_path").agg(
        F.array_sort(F.collect_list(F.struct("piece", "patches"))).alias("patched")
    )

    def rewrite_piece(piece: Column, patches: Column) -> Column:
        def from_the_end(chunks: Column) -> Column:
            def one(text: Column, head: Column) -> Column:
                def replaced(statement: Column) -> Column:
                    patch = F.get(F.filter(patches, lambda p: p["head"] == head), F.lit(0))
                    return F.when(patch.isNull(), statement).otherwise(_statement_patched(statement, patch))

                return let(F.concat(F.get(chunks, head), text), replaced)

            heads = F.sequence(F.size(chunks) - 1, F.lit(0), F.lit(-1))
            return F.aggregate(heads, F.lit(""), one)

        return let(_chunks(piece), from_the_end)

    def spliced(parts: Column) -> Column:
        """Each patched piece with the text from the one before it up to it, and then what is left."""

        def one(patched: Column, i: Column) -> Column:
            before = F.coalesce(F.get(F.col("patched"), i - 1)["piece"] * 2 + 2, F.lit(0))
            at = patched["piece"] * 2 + 1
            return F.concat(
                F.array_join(F.slice(parts["pieces"], before + 1, at - before), ""),
                rewrite_piece(F.get(parts["pieces"], at), patched["patches"]),
            )

        last = F.element_at("patched", -1)["piece"] * 2 + 2
        left = F.array_join(F.slice(parts["pieces"], last + 1, F.size(parts["pieces"])), "")
        return _restored(F.concat(F.array_join(F.transform("patched", one), ""), left, parts["rest"]))

    text = F.col(keep)
    return (
        _is_sql(files)
        .select(*by, "relative_path", keep)
        .join(of_file, [*by, "relative_path"], "left")
        .select(
            *by,
            "relative_path",
            F.when(F.col("patched").isNull(), text).otherwise(let(_cut(text), spliced)).alias("patched_content"),
        )
    )


def schema_trailer(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, trailer_ord key, statement): a guard per mutable ledger table, in finding order."""
    guards = (
        findings.filter("rule_id = 'FIN-IMM-001'")
        .filter(F.coalesce("table_name", F.lit("")) != "")
        .groupBy(*by, "table_name")
        .agg(F.min(F.struct(*ORDER_KEY)).alias("first"))
    )
    return guards.select(
        *by, "first", "table_name", _fill(_TRAILER_GUARD, F.col("table_name")).alias("statement")
    )


AUDIT_LOG_STATEMENT = "\n" + _AUDIT_LOG
