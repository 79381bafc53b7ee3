"""Table definitions out of DDL and Prisma text, as column expressions.

``schema_tables`` turns one file text into ``array<table>`` where a table is
``struct<name, columns, constraints, triggers, is_ledger_table>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyguard.constants import (
    GENERIC_SQL,
    LEDGER_WORDS,
    MYSQL,
    POSTGRESQL,
    PRISMA,
    SQLITE,
)
from tallyguard.functions.text import (
    NON_SPACE,
    QUOTES,
    SPACE,
    SPACE_CHARS,
    contains_any,
    let,
    lines,
    strip,
)

COLUMN_TYPE = (
    "struct<name:string,data_type:string,is_nullable:boolean,is_primary_key:boolean,"
    "is_foreign_key:boolean,references:string>"
)
TABLE_TYPE = (
    f"struct<name:string,columns:array<{COLUMN_TYPE}>,constraints:array<string>,"
    "triggers:array<string>,is_ledger_table:boolean>"
)

# The statement shapes that are recognised (format patterns).
_NAME = r"[a-zA-Z0-9_\"'`\.]+"
_TABLE_HEAD = rf"CREATE{SPACE}+TABLE{SPACE}+(?:IF{SPACE}+NOT{SPACE}+EXISTS{SPACE}+)?({_NAME}){SPACE}*\("
CREATE_TABLE = rf"(?isud){_TABLE_HEAD}.*?\)(?:;|(?={SPACE}*CREATE|{SPACE}*$))"
CREATE_TRIGGER = (
    rf"(?isud)(CREATE{SPACE}+(?:OR{SPACE}+REPLACE{SPACE}+)?TRIGGER{SPACE}+{_NAME}{SPACE}+"
    rf"(?:BEFORE|AFTER|INSTEAD{SPACE}+OF){SPACE}+(?:UPDATE|DELETE|INSERT){SPACE}+"
    rf"(?:OR{SPACE}+(?:UPDATE|DELETE|INSERT){SPACE}+)*ON{SPACE}+{_NAME}.*?)(?:;|$)"
)
_MODEL_HEAD = rf"model{SPACE}+([a-zA-Z0-9_]+){SPACE}*\{{"
PRISMA_MODEL = rf"{_MODEL_HEAD}[^}}]*\}}"
REFERENCED_TABLE = rf"(?iu)REFERENCES{SPACE}+({_NAME})"
PRISMA_REFERENCES = rf"@relation\([^)]*references:{SPACE}*\[([^\]]+)\]"
CONSTRAINT_STARTS = ["CONSTRAINT", "PRIMARY KEY", "FOREIGN KEY", "UNIQUE", "CHECK"]
_TWO_WORDS = rf"^({NON_SPACE}+){SPACE}+({NON_SPACE}+)"

# Elements of a column list without commas outside parentheses, parentheses nested up to three
# deep. Possessive throughout, so it runs in one pass without backtracking.
_ELEMENT = r"(?:[^,()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))++"
_INNERMOST = r"\([^()]*+\)"
_BLOCK = 128


def engine_type(path: Column, content: Column) -> Column:
    """Database engine of a file, by extension first and by words in its text after."""
    text = F.lower(content)
    return (
        F.when(F.lower(path).rlike(r"[^/]\.prisma\z"), F.lit(PRISMA))
        .when(text.contains("postgres"), F.lit(POSTGRESQL))
        .when(text.contains("mysql"), F.lit(MYSQL))
        .when(text.contains("sqlite"), F.lit(SQLITE))
        .otherwise(F.lit(GENERIC_SQL))
    )


def is_ledger_table(name: Column, ledger_words: Sequence[str] = LEDGER_WORDS) -> Column:
    return contains_any(F.lower(name), ledger_words)


def without_comments(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/", ""), r"--[^\n]*+", "")


def _is_shallow(body: Column) -> Column:
    """Balanced and at most three levels deep: three rounds of removal leave no parenthesis."""
    for _ in range(3):
        body = F.regexp_replace(body, _INNERMOST, "")
    return ~body.rlike("[()]")


def _split_by_depth(body: Column) -> Column:
    """Exact split for any text: cut at the commas where the running depth is zero.

    The running depth is a prefix sum over the comma-separated parts. It is taken block by block,
    so a body of n parts costs about n * sqrt(n) cheap steps instead of n * n.
    """

    def closes_minus_opens(part: Column) -> Column:
        without_open = F.replace(part, F.lit("("), F.lit(""))
        without_close = F.replace(part, F.lit(")"), F.lit(""))
        return F.length(without_close) - F.length(without_open)

    def running(values: Column, start: Column) -> Column:
        """Prefix sums of a short array, beginning at ``start``."""
        empty = F.expr("cast(array() as array<int>)")
        return F.aggregate(
            values,
            F.struct(start.alias("at"), empty.alias("seen")),
            lambda acc, v: F.struct(
                (acc["at"] + v).alias("at"),
                F.array_append(acc["seen"], acc["at"] + v).alias("seen"),
            ),
            lambda acc: acc["seen"],
        )

    def blocks(deltas: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(deltas), F.lit(_BLOCK))
        return F.transform(starts, lambda s: F.slice(deltas, s, F.lit(_BLOCK)))

    def depths(deltas: Column) -> Column:
        def with_offsets(chunks: Column) -> Column:
            totals = F.transform(
                chunks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)
            )
            return let(
                running(totals, F.lit(0)),
                lambda ends: F.flatten(
                    F.transform(
                        chunks,
                        lambda b, i: running(
                            b, F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
                        ),
                    )
                ),
            )

        return let(blocks(deltas), with_offsets)

    def cut(parts: Column) -> Column:
        last = F.size(parts) - 1
        ends_of = let(
            depths(F.transform(parts, closes_minus_opens)),
            lambda depth: F.filter(
                F.sequence(F.lit(0), last), lambda i: (F.get(depth, i) == 0) | (i == last)
            ),
        )
        return let(
            ends_of,
            lambda ends: F.transform(
                ends,
                lambda end, k: let(
                    F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1),
                    lambda start: F.array_join(F.slice(parts, start + 1, end - start + 1), ","),
                ),
            ),
        )

    return let(F.split(body, ",", -1), cut)


def split_elements(body: Column) -> Column:
    """Pieces of a column list, cut at the commas outside of any parenthesis."""
    return F.when(
        _is_shallow(body), F.regexp_extract_all(body, F.lit(_ELEMENT), F.lit(0))
    ).otherwise(_split_by_depth(body))


def _unquoted(name: Column) -> Column:
    return F.btrim(name, F.lit(QUOTES))


def _is_constraint(upper: Column) -> Column:
    found = F.lit(False)
    for start in CONSTRAINT_STARTS:
        found = found | upper.startswith(start)
    return found


def _sql_column(element: Column) -> Column:
    """struct<text, upper> of an element -> column struct, null for less than two words."""
    text, upper = element["text"], element["upper"]
    target = F.nullif(F.regexp_extract(text, REFERENCED_TABLE, 1), F.lit(""))

    def describe(name: Column) -> Column:
        is_reference = upper.contains("REFERENCES")
        return F.when(
            name != "",
            F.struct(
                _unquoted(name).alias("name"),
                F.regexp_extract(text, _TWO_WORDS, 2).alias("data_type"),
                (~upper.contains("NOT NULL")).alias("is_nullable"),
                upper.contains("PRIMARY KEY").alias("is_primary_key"),
                is_reference.alias("is_foreign_key"),
                F.when(is_reference, _unquoted(target)).alias("references"),
            ),
        )

    return let(F.regexp_extract(text, _TWO_WORDS, 1), describe)


def _sql_table(statement: Column, triggers: Column, ledger_words: Sequence[str]) -> Column:
    """One matched CREATE TABLE statement -> table struct."""
    end = F.when(statement.endswith(";"), F.lit(2)).otherwise(F.lit(1))

    def elements_of(head: Column) -> Column:
        start = F.length(head)
        body = F.substring(statement, start + 1, F.length(statement) - start - end)
        named = F.transform(
            F.transform(let(body, split_elements), strip),
            lambda e: F.struct(e.alias("text"), F.upper(e).alias("upper")),
        )
        return F.struct(
            _unquoted(F.regexp_extract(head, rf"(?isud){_TABLE_HEAD}", 1)).alias("name"),
            F.filter(named, lambda e: e["text"] != "").alias("elements"),
        )

    def assemble(parsed: Column) -> Column:
        name, elements = parsed["name"], parsed["elements"]
        on_table = [F.concat(F.lit(f"ON {q}"), name, F.lit(q)) for q in ("", "`", '"')]
        columns = F.transform(
            F.filter(elements, lambda e: ~_is_constraint(e["upper"])), _sql_column
        )
        return F.struct(
            name.alias("name"),
            F.filter(columns, lambda c: c.isNotNull()).alias("columns"),
            F.transform(
                F.filter(elements, lambda e: _is_constraint(e["upper"])), lambda e: e["text"]
            ).alias("constraints"),
            F.filter(
                triggers,
                lambda t: t.contains(on_table[0])
                | t.contains(on_table[1])
                | t.contains(on_table[2]),
            ).alias("triggers"),
            is_ledger_table(name, ledger_words).alias("is_ledger_table"),
        )

    head = F.regexp_extract(statement, rf"(?isud)^{_TABLE_HEAD}", 0)
    return let(let(head, elements_of), assemble)


def sql_tables(content: Column, ledger_words: Sequence[str] = LEDGER_WORDS) -> Column:
    """array<table> of a SQL text; texts without the word CREATE are not searched."""

    def find(text: Column) -> Column:
        statements = F.regexp_extract_all(text, F.lit(CREATE_TABLE), F.lit(0))
        triggers = F.transform(
            F.regexp_extract_all(text, F.lit(CREATE_TRIGGER), F.lit(1)), strip
        )
        return let(
            F.struct(statements.alias("statements"), triggers.alias("triggers")),
            lambda found: F.transform(
                found["statements"], lambda s: _sql_table(s, found["triggers"], ledger_words)
            ),
        )

    none = F.expr(f"cast(array() as array<{TABLE_TYPE}>)")
    return F.when(
        F.lower(content).contains("create"), let(without_comments(content), find)
    ).otherwise(none)


def _prisma_field(line: Column) -> Column:
    target = F.nullif(F.regexp_extract(line, PRISMA_REFERENCES, 1), F.lit(""))

    def describe(declared: Column) -> Column:
        is_relation = line.contains("@relation")
        return F.when(
            declared != "",
            F.struct(
                F.regexp_extract(line, _TWO_WORDS, 1).alias("name"),
                F.replace(declared, F.lit("?"), F.lit("")).alias("data_type"),
                declared.contains("?").alias("is_nullable"),
                line.contains("@id").alias("is_primary_key"),
                is_relation.alias("is_foreign_key"),
                F.when(is_relation, strip(target)).alias("references"),
            ),
        )

    return let(F.regexp_extract(line, _TWO_WORDS, 2), describe)


def prisma_tables(content: Column, ledger_words: Sequence[str] = LEDGER_WORDS) -> Column:
    """array<table> of a Prisma schema; models have neither constraints nor triggers."""

    def model(statement: Column) -> Column:
        name = F.regexp_extract(statement, rf"^{_MODEL_HEAD}", 1)
        body = F.regexp_extract(statement, r"\{([^}]*)\}", 1)
        fields = F.filter(
            F.transform(lines(body), strip),
            lambda s: (s != "") & ~s.startswith("//") & ~s.startswith("@@"),
        )
        columns = F.filter(F.transform(fields, _prisma_field), lambda c: c.isNotNull())
        return F.struct(
            name.alias("name"),
            columns.alias("columns"),
            F.expr("cast(array() as array<string>)").alias("constraints"),
            F.expr("cast(array() as array<string>)").alias("triggers"),
            is_ledger_table(name, ledger_words).alias("is_ledger_table"),
        )

    return F.transform(F.regexp_extract_all(content, F.lit(PRISMA_MODEL), F.lit(0)), model)


def schema_tables(
    engine: Column, content: Column, ledger_words: Sequence[str] = LEDGER_WORDS
) -> Column:
    """array<table> of a file, by its engine type."""
    return F.when(engine == PRISMA, prisma_tables(content, ledger_words)).otherwise(
        sql_tables(content, ledger_words)
    )


def first_non_empty(*extractions: Column) -> Column:
    """The first extraction that found a table; the last one if none did."""
    result = extractions[-1]
    for tables in reversed(extractions[:-1]):
        result = F.when(F.size(tables) > 0, tables).otherwise(result)
    return result


# --- ALTER statements and their order -------------------------------------------------------
ADD_COLUMN = (
    rf"(?iu)ALTER{SPACE}+TABLE{SPACE}+([^{SPACE_CHARS};]+){SPACE}+ADD{SPACE}+(?:COLUMN{SPACE}+)?"
    rf"([^{SPACE_CHARS};]+){SPACE}+([^{SPACE_CHARS};,]+)"
)
DROP_COLUMN = (
    rf"(?iu)ALTER{SPACE}+TABLE{SPACE}+([^{SPACE_CHARS};]+){SPACE}+DROP{SPACE}+(?:COLUMN{SPACE}+)?"
    rf"([^{SPACE_CHARS};,]+)"
)


def added_columns(content: Column) -> Column:
    """array<struct<table, name, data_type>> of the ADD statements, in text order."""
    return F.transform(
        F.regexp_extract_all(content, F.lit(ADD_COLUMN), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, ADD_COLUMN, 1).alias("table"),
            F.regexp_extract(m, ADD_COLUMN, 2).alias("name"),
            F.regexp_extract(m, ADD_COLUMN, 3).alias("data_type"),
        ),
    )


def dropped_columns(content: Column) -> Column:
    """array<struct<table, name>> of the DROP statements, in text order."""
    return F.transform(
        F.regexp_extract_all(content, F.lit(DROP_COLUMN), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, DROP_COLUMN, 1).alias("table"),
            F.regexp_extract(m, DROP_COLUMN, 2).alias("name"),
        ),
    )
