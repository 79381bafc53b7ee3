"""Live schemas: the columns of DataFrames and catalog tables as a columns frame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


_COLUMNS = "table_name string, col_ord int, name string, data_type string, is_nullable boolean"


def live_columns(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, col_ord, name, data_type, is_nullable) of the given frames.

    Only the schemas are looked at, so the size is the number of columns, a row each.
    """
    rows = [
        (table, position, field.name, field.dataType.simpleString(), field.nullable)
        for table, frame in frames.items()
        for position, field in enumerate(frame.schema.fields)
    ]
    return spark.createDataFrame(rows, _COLUMNS)


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The same for all tables and views of a catalog database."""
    names = [table.name for table in spark.catalog.listTables(database)]
    prefix = f"`{database}`." if database else ""
    return live_columns(spark, {name: spark.table(f"{prefix}`{name}`") for name in names})
