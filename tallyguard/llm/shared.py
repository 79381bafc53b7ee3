"""Dropping the keys that only one document has, before anything else is done with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tallyguard.llm.models import tidy

from tallyguard.llm import texts as tx
from tallyguard.llm.buckets import BLOCKS, keys_of_blocks, numbered_buckets, runs_of, to_blocks

KEYS_AT_ONCE = 500_000

Keyed = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def low_bytes(keys: np.ndarray, key_bytes: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * key_bytes) - 1) if key_bytes < 8 else keys


def _settled(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys several ids of this batch have, and one row for each key."""
    order = np.argsort(keys, kind="stable")
    first, count = runs_of(keys[order])
    several = np.zeros(len(keys), bool)
    several[order] = np.repeat(count > 1, count)
    return several, order[first]


def shared_keys(
    source: DataFrame, keys_of: Keyed, buckets: int, key_bytes: int = 8, flat: bool = False
) -> DataFrame:
    """(id, keys): the keys of each id that some other id has as well, as blocks of 64-bit numbers.

    ``keys_of`` gives (ids, keys) of a batch of ``source``, each pair once. A key that several ids
    of a batch have is settled there, and only one of them goes on; so a key that a large share of
    all rows has arrives once per batch and not once per row. An id can come out in several rows, and
    a key twice. With fewer ``key_bytes`` keys are compared by their low bytes and their bucket, and
    chance agreements come out too. A ``flat`` result has a row (id, key) for each of them.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()

        def blocks(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            ids, keys = (np.concatenate(column) for column in zip(*found))
            several, one = _settled(ids, keys)
            yield to_blocks(keys[one], ids[one], buckets, key_bytes)
            settled = to_blocks(keys[several], ids[several], 1, key_bytes)
            # numbers from ``buckets`` on are for answers that only pass through
            number = pa.array([buckets + turn % buckets] * settled.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([number, *settled.columns[1:]], names=["bucket", "keys", "ids"])

        found, size = [], 0
        for batch in batches:
            for ids, keys in keys_of(batch):
                found.append((ids, keys))
                size += len(keys)
                if size >= KEYS_AT_ONCE:
                    yield from blocks(found)
                    found, size = [], 0
                    turn += 1
        if found:
            yield from blocks(found)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in numbered_buckets(batches):
            # answers that pass through need not be held together
            for some in [rows] if number < buckets else [[row] for row in rows]:
                keys = keys_of_blocks([row[0] for row in some], key_bytes)
                ids = np.frombuffer(b"".join(row[1] for row in some), np.int64)
                if number < buckets:
                    order = np.argsort(keys, kind="stable")
                    keys, ids = keys[order], ids[order]
                    count = runs_of(keys)[1]
                    several = np.repeat(count > 1, count)
                    keys, ids = keys[several], ids[several]
                if flat:
                    columns = [pa.array(ids, pa.int64()), pa.array(keys.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "key"])
                    continue
                order = np.argsort(ids, kind="stable")
                keys, ids = keys[order], ids[order]
                first = runs_of(ids)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first], pa.int64()), tx.binaries(keys, np.append(first, len(keys)))],
                    names=["id", "keys"],
                )

    return (
        source.mapInArrow(tidy(deal), BLOCKS)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(tidy(answer), "id long, key long" if flat else "id long, keys binary")
    )


def member_mask(lists: pa.Array, text: np.ndarray, keys: np.ndarray, key_bytes: int = 8) -> np.ndarray:
    """Which (text, key) are among the keys of that text; ``lists`` has the key blocks of each text."""
    blocks = lists.to_pylist()
    known = np.frombuffer(b"".join(block for of_text in blocks for block in of_text), np.uint64)
    owner = np.repeat(np.arange(len(blocks)), [sum(map(len, of_text)) // 8 for of_text in blocks])
    return np.isin(
        tx.mix(low_bytes(keys, key_bytes) ^ tx.mix(text, 21)), tx.mix(known ^ tx.mix(owner, 21))
    )
