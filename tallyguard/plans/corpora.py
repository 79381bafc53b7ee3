"""Text corpora as projections of the given tables.

The tables hold no schema files, so the registered queries audit texts that are computed from
their keys. The expressions stay within the SQL that Spark and the comparison engine share, so
both sides compute the same corpus from the same rows. About a third of every corpus belongs to
one database or one file, to keep hot groups in view.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyguard.sources.tables import read_table


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a given table, which may arrive as one file, dealt to as many tasks as there are cores.

    The corpora are a few bytes a row here and long texts behind the projection, so they are dealt before
    it. The library itself takes files as they are partitioned.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class Projection:
    """SELECT <columns> FROM <table> WHERE <condition>."""

    table: str
    columns: dict[str, str]
    where: str = "true"

    def sql(self) -> str:
        listed = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        return f"SELECT {listed} FROM {self.table} WHERE {self.where}"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(read_table(spark, sf_dir, self.table).filter(self.where))
        return rows.selectExpr(*[f"{expr} AS {name}" for name, expr in self.columns.items()])


def _text(value: str) -> str:
    return f"CAST({value} AS STRING)"


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _case(*branches: tuple[str, str], default: str = "''") -> str:
    whens = " ".join(f"WHEN {cond} THEN {value}" for cond, value in branches)
    return f"CASE {whens} ELSE {default} END"


NL = "chr(10)"

# --- DDL corpus: one schema file per order ----------------------------------------------------
K = "o_orderkey"
KEY = _text(K)
IS_PRISMA = f"{K} % 13 = 5"
MAIN_NAME = _cat(
    _case(
        (f"{K} % 5 = 0", "'ledger_'"),
        (f"{K} % 5 = 1", "'users_'"),
        (f"{K} % 5 = 2", "'wallet_'"),
        (f"{K} % 5 = 3", "'catalog_'"),
        default="'transaction_'",
    ),
    KEY,
)
_QUOTE = _case((f"{K} % 6 = 1", "'\"'"), (f"{K} % 6 = 2", "'`'"))
DDL_DB = _case((f"{K} % 3 = 0", "'db_main'"), default=_cat("'db_'", _text(f"{K} % 50")))
DDL_PATH = _cat(
    DDL_DB, "'/schema_'", KEY, _case((IS_PRISMA, "'.prisma'"), default="'.sql'")
)
STATUS_TYPE = "VARCHAR(10)"
DDL_BODY = _cat(
    NL,
    _lit("  id BIGINT PRIMARY KEY,"),
    NL,
    _lit("  owner_id INT REFERENCES owners(id)"),
    _case((f"{K} % 3 = 0", _lit(" ON DELETE CASCADE"))),
    _lit(", -- owner, of record"),
    NL,
    _lit("  amount DECIMAL(15,2) NOT NULL,"),
    NL,
    _case(
        (f"{K} % 7 = 0", _cat(_lit("  bvn VARCHAR(11),"), NL)),
        (f"{K} % 7 = 1", _cat(_lit("  nin CHAR(11),"), NL)),
        (f"{K} % 7 = 2", _cat(_lit("  bvn_encrypted BYTEA,"), NL)),
    ),
    _case(
        (f"{K} % 11 = 0", _cat(_lit("  card_pan VARCHAR(16),"), NL)),
        (f"{K} % 11 = 1", _cat(_lit("  card_pan_last4 CHAR(4),"), NL)),
    ),
    _case((f"{K} % 2 = 0", _cat(_lit("  created_at TIMESTAMP DEFAULT now(),"), NL))),
    _lit(f"  status {STATUS_TYPE}"),
    _case((f"{K} % 17 = 0", _lit(" DEFAULT (coalesce(trim(lower(('x'))), 'a,b'))"))),
    _case(
        (f"{K} % 4 = 0", _cat(_lit(","), NL, _lit("  CONSTRAINT chk_"), KEY, _lit(" CHECK (amount >= 0)"))),
        (f"{K} % 4 = 1", _cat(_lit(","), NL, _lit("  UNIQUE (id, status)"))),
    ),
    NL,
)
DDL_CREATE = _cat(
    _lit("CREATE TABLE "),
    _case((f"{K} % 8 = 0", _lit("IF NOT EXISTS "))),
    _QUOTE,
    MAIN_NAME,
    _QUOTE,
    _lit(" ("),
    DDL_BODY,
    _lit(");"),
)
TRIGGER_TEXT = _cat(
    _lit("CREATE TRIGGER trg_"),
    KEY,
    _case(
        (f"{K} % 10 = 0", _lit(" BEFORE UPDATE OR DELETE ON ")),
        default=_lit(" AFTER INSERT ON "),
    ),
    _QUOTE,
    MAIN_NAME,
    _QUOTE,
    _lit(" FOR EACH ROW EXECUTE FUNCTION guard()"),
)
_SQL_CONTENT = _cat(
    _case(
        (f"{K} % 4 = 0", _lit("-- engine: PostgreSQL")),
        (f"{K} % 4 = 1", _lit("-- engine: MySQL")),
        (f"{K} % 4 = 2", _lit("-- sqlite dump")),
        default=_lit("-- generic"),
    ),
    NL,
    _lit("/* file "),
    KEY,
    _lit("; CREATE TABLE ghost (x INT); */"),
    NL,
    DDL_CREATE,
    NL,
    _case(
        (
            f"{K} % 9 = 0",
            _cat(
                _lit("CREATE TABLE audit_log_"),
                KEY,
                _lit(" (id BIGINT PRIMARY KEY, note TEXT);"),
                NL,
            ),
        )
    ),
    _case((f"{K} % 5 = 0", _cat(TRIGGER_TEXT, _lit(";"), NL))),
)
_PRISMA_CONTENT = _cat(
    _lit("datasource db {"),
    NL,
    _lit('  provider = "postgresql"'),
    NL,
    _lit("}"),
    NL,
    _lit("model Wallet"),
    KEY,
    _lit(" {"),
    NL,
    _lit("  id Int @id"),
    NL,
    _lit("  // a comment line"),
    NL,
    _lit("  pan String"),
    _case((f"{K} % 2 = 0", "'?'")),
    NL,
    _lit("  owner User @relation(fields: [ownerId], references: [id])"),
    NL,
    _lit('  @@map("wallet")'),
    NL,
    _lit("}"),
    NL,
)
DDL_CONTENT = _case((IS_PRISMA, _PRISMA_CONTENT), default=_SQL_CONTENT)
DDL_CORPUS = Projection(
    "orders", {"db": DDL_DB, "relative_path": DDL_PATH, "content": DDL_CONTENT}
)

# --- seed corpus: one file with secrets per customer --------------------------------------------
C = "c_custkey"
CKEY = _text(C)
SEED_PATH = _cat(_lit("seed/customer_"), CKEY, _lit(".sql"))
_TEN = f"lpad({CKEY}, 10, '0')"
_FIFTEEN = f"lpad({CKEY}, 15, '0')"
_URI_TEXT = _cat(_lit("app:pw"), CKEY, _lit("@db.internal:5432/core"))
SEED_LINES = {
    # line number: (condition, text before, secret, text after, category); None = no secret
    1: ("true", _lit("INSERT INTO users (bvn, nin) VALUES ("), _cat("chr(39)", "'2'", _TEN, "chr(39)"), _lit(","), "PLAINTEXT_BVN"),
    2: ("true", _lit(" "), _cat("chr(39)", "'1'", _TEN, "chr(39)"), _lit(");"), "PLAINTEXT_NIN"),
    3: (f"{C} % 2 = 0", _lit("-- "), _cat(_lit("card_number = 4"), _FIFTEEN), "''", "PLAINTEXT_PAN"),
    4: (
        f"{C} % 3 <> 2",
        _cat(_lit("url: "), _case((f"{C} % 3 = 1", _lit("mysql+py")))),
        _cat(_case((f"{C} % 3 = 0", _lit("postgres://")), default=_lit("mysql://")), _URI_TEXT),
        _lit(" ok"),
        "DATABASE_URI",
    ),
    5: (
        f"{C} % 5 < 3",
        _lit("key="),
        _case(
            (f"{C} % 5 = 0", _cat(_lit("AKIA"), f"lpad({CKEY}, 16, 'Z')")),
            (f"{C} % 5 = 1", _cat(_lit("sk_live_"), CKEY)),
            default=_cat(_lit("FLWSECK-"), CKEY),
        ),
        _lit("-X"),
        "GENERIC_SECRET",
    ),
    6: (f"{C} % 4 = 0", _lit("set "), _cat(_lit('Secret_Key = "k'), CKEY, _lit('"')), "''", "ENCRYPTION_KEY"),
}
# what stands in a line whose secret is absent
SEED_PLAIN = {
    3: _lit("-- no card"),
    4: _cat(_lit("url: postgresql://"), _URI_TEXT, _lit(" ok")),
    5: _cat(_lit("key=sk-"), CKEY, _lit("-X")),
    6: _lit("set nothing"),
}
SEED_CONTENT = _cat(
    *[
        part
        for number, (cond, before, secret, after, _) in SEED_LINES.items()
        for part in (
            _cat(before, secret, after)
            if cond == "true"
            else _case((cond, _cat(before, secret, after)), default=SEED_PLAIN[number]),
            NL,
        )
    ]
)
SEED_CORPUS = Projection(
    "customer",
    {
        "nation": "c_nationkey",
        "relative_path": SEED_PATH,
        "content": SEED_CONTENT,
    },
)

# --- config corpus: one line per event -----------------------------------------------------------
E = "event_id"
EKEY = _text(E)
LINE_KIND = f"(({E} * 7 + user_id) % 24)"
CONFIG_PATH = _case(
    ("user_id % 3 = 0", _lit("conf/main.conf")),
    ("user_id % 3 = 1", _cat(_lit("conf/test/user_"), _text("user_id"), _lit(".conf"))),
    default=_cat(_lit("conf/app/user_"), _text("user_id"), _lit(".conf")),
)
CONFIG_TEXTS = {
    0: _lit("cors:"),
    1: _lit('  - "*"'),
    2: _lit("  origins: '*'"),
    3: _lit("Access-Control-Allow-Origin: *"),
    4: _lit("DEBUG = true"),
    5: _lit("  Debug: TRUE"),
    6: _cat(_lit("log_retention = 0"), _text(f"{E} % 200"), _lit(" days")),
    7: _lit("rate_limit = 0"),
    8: _lit("bind = 0.0.0.0 port: 3306"),
    9: _lit("port: 5432"),
    10: _lit("ssl=false"),
    11: _cat(_lit("url = http://host"), EKEY, _lit("/x")),
    12: _lit("url = http://localhost/x"),
    13: _lit("database_url = from vault"),
    14: _lit("database_url = from vault sslmode=require"),
    15: _lit("encryption : off"),
    16: _cat(_lit("contact = a"), EKEY, _lit("@mail.example.org")),
    17: _cat(_lit("phone 0"), f"lpad({EKEY}, 10, '7')"),
    18: _lit("cache ttl=0"),
    19: _lit("tracking on, consent=false"),
    20: _lit("owner = Chukwu"),
    21: _cat(_lit("aws = AKIA"), f"lpad({EKEY}, 16, 'A')"),
    22: _cat(_lit("store: redis://cache/"), EKEY),
}
CONFIG_LINE = _case(
    *[(f"{LINE_KIND} = {kind}", text) for kind, text in CONFIG_TEXTS.items()],
    default=_cat(_lit("plain line "), EKEY),
)
CONFIG_CORPUS = Projection(
    "events", {"relative_path": CONFIG_PATH, "line_number": f"{E} + 1", "line": CONFIG_LINE}
)

# --- migration corpus: a first file per order, one more per line item ------------------------------


def _migration_db(key: str) -> str:
    return _case((f"{key} % 3 = 0", "'db_main'"), default=_cat("'db_'", _text(key)))


def _migration_dir(key: str) -> str:
    return _cat("'m'", f"lpad({_text(key)}, 12, '0')", "'/'")


def _ledger_create(key: str, extra: str) -> str:
    return _cat(
        _lit("CREATE TABLE Ledger_"),
        _text(key),
        _lit(" (id BIGINT PRIMARY KEY, amount DECIMAL(10,2) NOT NULL, status TEXT"),
        extra,
        _lit(");"),
    )


MIGRATION_FILES = [
    Projection(
        "orders",
        {
            "db": _migration_db(K),
            "relative_path": _cat(_migration_dir(K), _lit("0000_init.sql")),
            "content": _cat(
                _ledger_create(K, "''"),
                NL,
                _lit("CREATE TABLE audit_"),
                KEY,
                _lit(" (id INT, bvn CHAR(11));"),
            ),
        },
    ),
    Projection(
        "orders",
        {
            "db": _migration_db(K),
            "relative_path": _cat(_migration_dir(K), _lit("0003_reset.sql")),
            "content": _ledger_create(K, _lit(", c1 INT, created_at DATE")),
        },
        f"{K} % 5 = 0",
    ),
    Projection(
        "lineitem",
        {
            "db": _migration_db("l_orderkey"),
            "relative_path": _cat(
                _migration_dir("l_orderkey"),
                f"lpad({_text('l_linenumber')}, 4, '0')",
                "'_'",
                f"lpad({_text('l_partkey')}, 12, '0')",
                "'_'",
                f"lpad({_text('l_suppkey')}, 10, '0')",
                "'_'",
                _text("CAST(round(l_extendedprice * 100) AS BIGINT)"),
                _lit(".sql"),
            ),
            "content": _case(
                (
                    "l_partkey % 4 < 2",
                    _cat(
                        _lit("ALTER TABLE ledger_"),
                        _text("l_orderkey"),
                        _lit(" ADD COLUMN c"),
                        _text("l_partkey % 6"),
                        _lit(" VARCHAR("),
                        _text("l_suppkey % 20"),
                        _lit(");"),
                    ),
                ),
                (
                    "l_partkey % 4 = 2",
                    _cat(
                        _lit("ALTER TABLE ledger_"),
                        _text("l_orderkey"),
                        _lit(" DROP COLUMN C"),
                        _text("l_partkey % 6"),
                        _lit(";"),
                    ),
                ),
                default=_cat(
                    _lit('alter table "LEDGER_'),
                    _text("l_orderkey"),
                    _lit('" drop status; ALTER TABLE `ledger_'),
                    _text("l_orderkey"),
                    _lit("` ADD Note INT, ADD other INT;"),
                ),
            ),
        },
    ),
]
MIGRATION_SQL = " UNION ALL ".join(p.sql() for p in MIGRATION_FILES)


def migration_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *others = [p.frame(spark, sf_dir) for p in MIGRATION_FILES]
    for other in others:
        first = first.unionByName(other)
    return first


# --- documents with two secrets appended to every text ---------------------------------------------
D = "doc_id"
DKEY = _text(D)
SECRET_DOCUMENTS = Projection(
    "documents",
    {
        "doc_id": D,
        "source": "source",
        "content": _cat(
            "text",
            NL,
            _lit("aws_key=AKIA"),
            f"lpad({DKEY}, 16, '0')",
            _lit(" and again AKIA"),
            f"lpad({DKEY}, 16, 'B')",
            NL,
            _lit("url=mysql://reader:pw@host"),
            DKEY,
            _lit("/db"),
        ),
    },
)
