"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTES_AT_ONCE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# 0x20 and 0x09-0x0D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# all ASCII but digits and lower-case letters, for texts in lower case
NOT_IN_TERMS = np.zeros(256, bool)
NOT_IN_TERMS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: a one-to-one map whose output bits all depend on all input bits."""
    x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(256), 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text starts (and the last one ends).

    Null is an empty text.
    """
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return content[:0], np.zeros(1, np.int64)
    return content[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], text: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        starts = utf8(batch.column(text))[1]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BYTES_AT_ONCE + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class SpanHashes:
    """64-bit hashes of any stretches of ``content``, by prefix sums."""

    def __init__(self, content: np.ndarray):
        forward, self.back = _power_tables(len(content) + 1)
        self.sums = np.zeros(len(content) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[content] * forward[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts], 2)

    def windows(self, width: int) -> np.ndarray:
        """The hash of ``width`` bytes from every place that has so many behind it."""
        count = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:count]) * self.back[:count], 2)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` values from every place that has so many."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: max(0, len(values) - span)], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: max(0, len(values) - rest)], values[rest:]) if rest else values


def words(
    content: np.ndarray, starts: np.ndarray, between: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word, and the text it is in. Words end with the text.

    ``between`` tells which bytes stand between words.
    """
    n = len(content)
    inside = ~between[content]
    border = np.zeros(n + 1, bool)
    border[starts] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    first = np.flatnonzero(inside & (~before | border[:n]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    end = np.flatnonzero(inside & (~after | border[1 : n + 1])) + 1
    text = np.searchsorted(starts, first, "right") - 1
    return first, end, text


def word_shingles(
    content: np.ndarray, starts: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, number of its first word) of every run of ``size`` words, in order.

    A text of fewer words, but at least one, has its whole sequence as one run. Texts are taken as
    they are; lower their case before.
    """
    first, end, text = words(content, starts)
    values = SpanHashes(content)(first, end)
    counts = np.bincount(text, minlength=len(starts) - 1)
    begins = np.concatenate([[0], np.cumsum(counts)])
    index = np.arange(len(values)) - begins[text]
    runs = np.flatnonzero(index + size <= counts[text])
    total = np.zeros(len(runs), np.uint64)
    for k in range(size):
        total = mix(total + values[runs + k], 3 + k)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return text[runs], total, index[runs]
    whole = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        at = begins[short][has] + k
        whole[has] = mix(whole[has] + values[at], 3 + k)
    whole = mix(whole + counts[short].astype(np.uint64), 101)
    texts = np.concatenate([text[runs], short])
    order = np.argsort(texts, kind="stable")
    hashes, places = np.concatenate([total, whole]), np.concatenate([index[runs], np.zeros(len(short), int)])
    return texts[order], hashes[order], places[order]


def distinct_in_groups(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (group, value), sorted; groups are small non-negative integers."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    group, values = group[order], values[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (values[1:] != values[:-1])
    return group[new], values[new]


def binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values; ``starts`` has one more entry than there are."""
    width = values.dtype.itemsize
    offsets = pa.py_buffer((starts.astype(np.int64) * width).tobytes())
    content = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, offsets, content]).cast(pa.binary())
