"""Bringing equal keys together in bulk: keys travel as binary blocks, a row per batch and bucket.

This is a shuffle by key whose rows are blocks of keys, for keys of which there are some per line of
text. The number of buckets follows the number of input partitions, so a bucket stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_BUCKETS = 64
BLOCKS = "bucket int, keys binary, ids binary"


def bucket_count(df: DataFrame) -> int:
    return max(LEAST_BUCKETS, 4 * df.rdd.getNumPartitions())


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


def cut(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """The order that sorts keys by bucket, and the number, start and end of each bucket in it."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    first, length = runs_of(bucket[order])
    return order, bucket[order][first].tolist(), first.tolist(), (first + length).tolist()


def to_blocks(keys: np.ndarray, ids: np.ndarray, buckets: int, key_bytes: int = 8) -> pa.RecordBatch:
    """Keys (64 bits) and their ids (64 bits), dealt into rows of (bucket, keys, ids).

    With fewer ``key_bytes`` only the low bytes of the keys travel, for uses where keys that happen
    to agree in them and in their bucket do no harm.
    """
    keys = keys.view(np.uint64)
    order, numbers, first, end = cut(keys, buckets)
    low = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :key_bytes]
    ids = ids[order]
    spans = list(zip(first, end))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers, pa.int32()),
            pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
        ],
        names=["bucket", "keys", "ids"],
    )


def keys_of_blocks(blocks: list[bytes], key_bytes: int) -> np.ndarray:
    low = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, key_bytes)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :key_bytes] = low
    return wide.view("<u8").ravel()


def numbered_buckets(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[int, list[tuple]]]:
    """The number and the rows of each bucket, from batches that are sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append(tuple(row))
    if rows:
        yield now, rows


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, int), np.zeros(0, int)
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return first, np.diff(np.append(first, len(sorted_values)))
