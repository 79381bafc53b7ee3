"""Consecutive numbers for a totally ordered frame, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.materialise import materialise, materialise_counted

# monotonically_increasing_id keeps the partition above, the row below this bit.
_ROW_BITS = 33


def number_rows(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "idx"
) -> tuple[DataFrame, int]:
    """Adds ``name``: 0, 1, 2, ... in the given (total) order; also gives the number of rows.

    A range-partitioned sort, then each partition's start is added to the position inside the
    partition. The sorted frame is materialised, because both steps must see the same partitions.
    """
    ordered, total = materialise_counted(
        df.orderBy(*order_by).withColumn("_row", F.monotonically_increasing_id())
    )
    partition = F.shiftright("_row", _ROW_BITS)
    counts = ordered.groupBy(partition.alias("_partition")).agg(F.count("*").alias("_n"))
    # one row per partition of the sort: as small as the number of tasks
    starts = counts.select(
        "_partition",
        (
            F.sum("_n").over(Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_n")
        ).alias("_start"),
    )
    position = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = (
        ordered.withColumn("_partition", partition)
        .join(F.broadcast(starts), "_partition")
        .withColumn(name, F.col("_start") + position)
        .drop("_partition", "_start", "_row")
    )
    return numbered, total


def number_rows_by(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column], name: str = "idx"
) -> tuple[DataFrame, DataFrame]:
    """Adds ``name``: 0, 1, 2, ... within each group; also gives (by, rows) of the groups.

    The rows of all groups are numbered in one range sort, so a group of any share spreads over tasks;
    the first number of its group, one row per group, is then taken off.
    """
    numbered, _ = number_rows(df, [*by, *order_by], "_of_all")
    groups = materialise(
        numbered.groupBy(*by).agg(F.min("_of_all").alias("_first"), F.count("*").alias("rows"))
    )
    first = groups.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    placed = numbered.join(first, same).withColumn(name, F.col("_of_all") - F.col("_first"))
    return placed.drop("_of_all", "_first", *[f"_g{i}" for i in range(len(by))]), groups.drop("_first")
