"""Merkle root over ordered texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.materialise import materialise
from tallyguard.operators.numbering import number_rows, number_rows_by

# Leaves that one row reduces at a time: 2**10 hashes, some 80 kB.
LEVELS_PER_PASS = 10

# Fixed value: the root that stands for "no claims".
EMPTY_ROOT = "7fd7f7f3220e88303d16ce7f6019f8dd6b8e4ba29c897838590656da81d37270"


def _next_level(nodes: Column) -> Column:
    """Hashes of the pairs of ``nodes``; a node without a partner is paired with itself."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))

    def join_pair(i: Column) -> Column:
        left = F.get(nodes, i * 2)
        right = F.coalesce(F.get(nodes, i * 2 + 1), left)
        return F.sha2(F.concat(left, right), 256)

    return F.transform(pairs, join_pair)


def fold_levels(nodes: Column, levels: int) -> Column:
    """``levels`` rounds of pairing inside one array."""
    if levels == 0:
        return nodes
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(levels)), nodes, lambda acc, _: _next_level(acc)
    )


def root_of_array(claims: Column, size: int) -> Column:
    """Root of an array of texts whose length is known when the plan is made."""
    if size == 0:
        return F.lit(EMPTY_ROOT)
    leaves = F.transform(claims, lambda c: F.sha2(c, 256))
    return fold_levels(leaves, (size - 1).bit_length()).getItem(0)


def merkle_root(
    df: DataFrame,
    order_by: Sequence[str | Column],
    leaf: str | Column,
    levels_per_pass: int = LEVELS_PER_PASS,
) -> DataFrame:
    """One row: (leaf_count, merkle_root) over the rows of ``df`` in the given total order.

    Leaves are numbered once; then every pass replaces aligned runs of 2**levels_per_pass nodes by
    the node above them. All runs but the last are complete, so pairing inside a run equals
    pairing over the whole level, and the group size is bounded. A trillion leaves take four
    passes.
    """
    spark = df.sparkSession
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    named = [key.alias(f"_k{i}") for i, key in enumerate(keys)]
    hashed = df.select(*named, F.sha2(leaf, 256).alias("h"))
    numbered, total = number_rows(hashed, [f"_k{i}" for i in range(len(keys))])
    nodes = numbered.select("idx", "h")
    if total == 0:
        return spark.range(1).select(
            F.lit(0).cast("bigint").alias("leaf_count"), F.lit(EMPTY_ROOT).alias("merkle_root")
        )

    remaining = total
    while remaining > 1:
        levels = min(levels_per_pass, (remaining - 1).bit_length())
        run = F.shiftright("idx", levels)
        ordered = F.transform(
            F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda node: node["h"]
        )
        nodes = (
            nodes.groupBy(run.alias("run"))
            .agg(fold_levels(ordered, levels).getItem(0).alias("h"))
            .select(F.col("run").alias("idx"), "h")
        )
        remaining = ((remaining - 1) >> levels) + 1
    return nodes.select(
        F.lit(total).cast("bigint").alias("leaf_count"), F.col("h").alias("merkle_root")
    )


def _levels_of(remaining: Column) -> Column:
    """How often a list of so many nodes has to be halved: the bits of remaining - 1."""
    return F.when(remaining > 1, F.length(F.bin(remaining - 1))).otherwise(0)


def merkle_roots(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str | Column],
    leaf: str | Column,
    levels_per_pass: int = LEVELS_PER_PASS,
) -> DataFrame:
    """(by, leaf_count, merkle_root): the root of every group, in the given total order within it.

    All groups are folded in the same passes. A run holds at most 2**levels_per_pass nodes of one group;
    a group that needs fewer levels is done with fewer, and its root then passes through. A group
    exists by its rows, so none is empty.
    """
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    named = [key.alias(f"_k{i}") for i, key in enumerate(keys)]
    hashed = df.select(*by, *named, F.sha2(leaf, 256).alias("h"))
    numbered, groups = number_rows_by(hashed, by, [f"_k{i}" for i in range(len(keys))])
    largest = groups.agg(F.max("rows").alias("n")).first()["n"] or 0
    sizes = groups.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("rows").alias("leaf_count"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    nodes = numbered.join(sizes, same).select(
        *by, "idx", "h", "leaf_count", F.col("leaf_count").alias("remaining")
    )
    while largest > 1:
        levels = F.least(F.lit(levels_per_pass), _levels_of(F.col("remaining"))).cast("int")
        ordered = F.transform(
            F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda node: node["h"]
        )
        # every node of a group carries the same counts
        counts = [F.first(c).alias(c) for c in ("leaf_count", "remaining", "levels")]
        folded = F.when(
            F.col("levels") > 0,
            F.aggregate(
                F.sequence(F.lit(1), F.greatest("levels", F.lit(1))), F.col("nodes"), lambda acc, _: _next_level(acc)
            ),
        ).otherwise(F.col("nodes"))
        nodes = (
            nodes.withColumn("levels", levels)
            .withColumn("run", F.expr("shiftright(idx, levels)"))
            .groupBy(*by, "run")
            .agg(ordered.alias("nodes"), *counts)
            .select(
                *by,
                F.col("run").alias("idx"),
                folded.getItem(0).alias("h"),
                "leaf_count",
                (F.expr("shiftright(remaining - 1, levels)") + 1).alias("remaining"),
            )
        )
        largest = ((largest - 1) >> levels_per_pass) + 1
    return materialise(nodes.select(*by, "leaf_count", F.col("h").alias("merkle_root")))
