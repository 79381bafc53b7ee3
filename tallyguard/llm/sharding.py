"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots. The bytes of each slot are summed, and a map from
slots to shards is made from these sums alone: it has one row per slot, whatever the size of the
data. Maps are stored by version. Rebalancing edits a copy of the last version, moving as few slots
as it needs, and stores it as the next one; records of other slots stay where they are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.operators.materialise import materialise

SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long, first long"


def records(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every row; size is the UTF-8 bytes plus 8.

    The slot is a hash of the id and the text's checksum, so rows that share an id, or have none,
    spread as well; a null text has no bytes. Only full repeats of a row share a slot for certain.
    """
    checksum = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0).cast("long"))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        checksum.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), checksum), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def _with_starts(version: int, placed: list[tuple[int, int, int, int]]) -> list[tuple]:
    """Map rows, with the first place of each slot inside its shard (slots in numeric order)."""
    rows, used = [], {}
    for slot, shard, size, count in sorted(placed):
        rows.append((version, slot, shard, size, count, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + count
    return rows


def new_map(totals: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """Version 1 of the map: (slot, bytes, rows) by size, each to the shard with the fewest bytes."""
    load = [(0, shard) for shard in range(shards)]
    placed = []
    for slot, size, count in sorted(totals, key=lambda t: (-t[1], t[0])):
        filled, shard = heapq.heappop(load)
        placed.append((slot, shard, size, count))
        heapq.heappush(load, (filled + size, shard))
    return _with_starts(1, placed)


def edited_map(
    last: list[tuple], totals: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01
) -> list[tuple]:
    """The next version, for new sums per slot or another number of shards.

    Slots of shards that no longer exist move first. Then slots go from the fullest to the emptiest
    shard, each time the one nearest to half of their difference, until no shard is above the mean
    by more than ``tolerance`` or no move helps.
    """
    of_slot = {row[1]: row[2] for row in last}
    members: list[dict[int, int]] = [{} for _ in range(shards)]
    counts = {slot: count for slot, _, count in totals}
    homeless = []
    for slot, size, _ in sorted(totals, key=lambda t: (-t[1], t[0])):
        shard = of_slot.get(slot, shards)
        if shard < shards:
            members[shard][slot] = size
        else:
            homeless.append((slot, size))
    load = [sum(m.values()) for m in members]

    def put(slot: int, size: int, shard: int) -> None:
        members[shard][slot] = size
        load[shard] += size

    for slot, size in homeless:
        put(slot, size, load.index(min(load)))
    mean = sum(load) / shards
    while (most := max(load)) > mean * (1 + tolerance):
        source, target = load.index(most), load.index(min(load))
        gap = most - load[target]
        fitting = [(abs(gap / 2 - s), slot) for slot, s in members[source].items() if 0 < s < gap]
        if not fitting:
            break
        slot = min(fitting)[1]
        size = members[source].pop(slot)
        load[source] -= size
        put(slot, size, target)
    placed = [(slot, i, s, counts[slot]) for i, m in enumerate(members) for slot, s in m.items()]
    return _with_starts(last[0][0] + 1 if last else 1, placed)


def slot_totals(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows); at most as many rows as there are slots, so the driver may hold them."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*"))
    return [tuple(r) for r in sums.collect()]


def save_map(spark: SparkSession, rows: list[tuple], path: str) -> DataFrame:
    """Adds a version to the maps stored at ``path`` and reads it back."""
    frame = spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
    version = rows[0][0] if rows else 1
    frame.write.mode("errorifexists").parquet(f"{path}/v{version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{version}")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot, the place in the shard: 0, 1, 2, ... without gaps.

    A place is the slot's first place plus the number inside the virtual slot, so no task sorts
    more than one of the thousands of slots. The map has one row per slot and is broadcast.
    """
    inside = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size")
    joined = rows.withColumn("inside", F.row_number().over(inside) - 1).join(
        F.broadcast(slot_map.select("virtual_slot", "shard", "first", "version")), "virtual_slot"
    )
    return joined.withColumn("slot", F.col("first") + F.col("inside")).drop("first", "inside")


def shard_documents(
    docs: DataFrame,
    shards: int,
    map_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
) -> DataFrame:
    """All rows with shard, place and virtual slot, under a map stored as version 1 at ``map_path``.

    Shards hold nearly the same number of bytes. Rows repeated in full get places of their own; a
    null text has 8 bytes; an empty table gives no rows and an empty map. Other columns of ``docs``
    are not read.
    """
    rows = materialise(records(docs, id_col, text_col, slots))
    slot_map = save_map(docs.sparkSession, new_map(slot_totals(rows), shards), map_path)
    return place(rows, slot_map).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
