"""Rows whose whole text also belongs to a smaller id, found without moving texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.materialise import materialise

NULL_ID = -(1 << 63)


def texts_by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t): ids as numbers, null as the smallest; null texts as empty."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )


def with_first_copy(source: DataFrame, least_bytes: int) -> DataFrame:
    """(id, t) -> (id, t, first): the smallest id with the same text, null if it is the row's own.

    Texts are compared by 128 bits of hash. Only hashes are grouped; then texts are shuffled by id,
    an exchange that later joins by id can share. Texts below ``least_bytes`` count as no copies.
    """
    digests = [F.xxhash64("t").alias("d1"), F.xxhash64(F.lit(7), "t").alias("d2")]
    keyed = source.filter(F.octet_length("t") >= least_bytes).select("id", *digests)
    groups = materialise(
        keyed.groupBy("d1", "d2")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .filter("first < last")
        .drop("last")
    )
    copies = materialise(
        keyed.join(groups, ["d1", "d2"])
        .filter("id > first")
        .groupBy("id")
        .agg(F.collect_set(F.struct("d1", "first")).alias("copies"))
    )
    own = F.filter("copies", lambda c: c["d1"] == F.xxhash64("t"))
    return source.join(copies, "id", "left").select("id", "t", F.get(own, F.lit(0))["first"].alias("first"))
