"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name by sorting
the distinct blocks; then adjacent names are paired and the pairs named in turn, until every text
has a single name. Two texts of as many blocks have the same last name exactly when they are equal,
because a name stands for one content at every step; no step relies on a hash being unique.

Names travel back to the rows by the digest of the block, so that texts are shuffled once and only
as distinct blocks. That the digest stands for one block only is checked while names are given; if it
ever did not, the job would stop with an error instead of joining unequal texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.materialise import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_BYTES = 4096


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _blocks(content: Column, block_bytes: int) -> Column:
    """The binary ``content`` in pieces of ``block_bytes``; an empty one is a single empty block."""
    last = F.floor((F.greatest(F.octet_length(content), F.lit(1)) - 1) / block_bytes).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(content, i * block_bytes + 1, F.lit(block_bytes)),
    )


def _named(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct combinations of ``keys`` with an integer ``name``, given in sorted order."""
    return (
        parts.select(*keys)
        .distinct()
        .sortWithinPartitions(*reversed(keys))
        .withColumn("name", F.monotonically_increasing_id())
    )


def _identities(parts: DataFrame) -> DataFrame:
    """(row, n, pos, name) of all blocks -> (row, n, name) of all texts."""
    done = [parts.filter("n = 1").select("row", "n", "name")]
    open_parts = parts.filter("n > 1").withColumn("left_over", F.col("n"))
    most = open_parts.agg(F.max("n")).first()[0] or 1
    while most > 1:
        pairs = open_parts.groupBy(
            "row", "n", "left_over", F.shiftright("pos", 1).alias("pos")
        ).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        merged = materialise(
            pairs.join(_named(pairs, ["left", "right"]), ["left", "right"]).select(
                "row", "n", F.shiftright(F.col("left_over") + 1, 1).alias("left_over"), "pos", "name"
            )
        )
        done.append(merged.filter("left_over = 1").select("row", "n", "name"))
        open_parts = merged.filter("left_over > 1")
        most = (most + 1) // 2
    return reduce(DataFrame.union, done)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    id stays; where that id is repeated, exactly one of its rows. A null text counts as empty, a
    null id as smaller than any other. Other columns, whatever their names, are not read; an empty
    table gives an empty result. A text may be of any length: a row holds its names, not copies.
    """
    source = docs.select(F.col(id_col).alias("id"), lower_ascii(F.col(text_col)).alias("t"))
    content = F.col("t").cast("binary")
    digest = F.sha2(content, 256)
    rows = materialise(
        source.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            digest.alias("text_sha256"),
            F.when(F.octet_length("t") <= block_bytes, F.array(digest))
            .otherwise(F.transform(_blocks(content, block_bytes), lambda b: F.sha2(b, 256)))
            .alias("digests"),
        )
    )
    blocks = source.select(F.explode(_blocks(content, block_bytes)).alias("block"))
    names = (
        _named(blocks.withColumn("digest", F.sha2("block", 256)), ["digest", "block"])
        .groupBy("digest")
        .agg(F.min("name").alias("name"), F.count("*").alias("contents"))
        .withColumn(
            "name",
            F.when(F.col("contents") == 1, F.col("name")).otherwise(
                F.raise_error(F.lit("two blocks share a digest"))
            ),
        )
        .select("digest", "name")
    )
    parts = materialise(
        rows.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
        .join(names, "digest")
        .select("row", "n", "pos", "name")
    )
    members = materialise(rows.select("row", "id", "text_sha256").join(_identities(parts), "row"))
    # stored, so that the join below shuffles both sides itself and can split a large group
    groups = materialise(
        members.groupBy("n", "name").agg(
            F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size")
        )
    )
    return members.join(groups, ["n", "name"]).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )
