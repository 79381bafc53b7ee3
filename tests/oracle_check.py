"""Runs registered queries next to their comparison SQL: python tests/oracle_check.py sf0.01 [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows as texts, columns by name, rows sorted."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def difference(spark, connection, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty when the query and its SQL agree, else what differs."""
    found = query(spark, sf_dir)
    expected = connection.execute(sql)
    columns = [column[0] for column in expected.description]
    if sorted(found.columns) != sorted(columns):
        return f"columns {sorted(found.columns)} instead of {sorted(columns)}"
    left, right = canonical(found.columns, found.collect()), canonical(columns, expected.fetchall())
    if left == right:
        return "" if left else "no rows"
    missing = sorted(set(right) - set(left))[:3]
    surplus = sorted(set(left) - set(right))[:3]
    return f"{len(left)} rows instead of {len(right)}; missing {missing}; surplus {surplus}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    connection = connect(sf_dir)
    failed = 0
    for name, sql in entry.oracle_sql().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            problem = difference(spark, connection, sf_dir, name, entry.queries()[name], sql)
        except Exception as error:  # a broken query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{name}: {problem[:1500] or 'ok'} ({time.time() - started:.1f} s)", flush=True)
    print("queries without SQL:", sorted(set(entry.queries()) - set(entry.oracle_sql())))
    return failed


if __name__ == "__main__":
    sys.exit(main())
