"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

An occurrence of an item of m characters with at most e edits keeps at least m - q + 1 - q e of its
q-grams, all within e + 1 neighbouring diagonals of document place minus item place. Shared q-grams are
counted in overlapping bands of diagonals; bands that reach the bound are aligned in full, band by
band, and kept when the edit distance is within the budget.

Case and white space are evened out on both sides before. The benchmark is a stated set of queries:
it is read in blocks of bounded size, and each block meets all documents where they are, without a
shuffle. Its index is built once and broadcast. Where one block does not hold the benchmark, the rows are
stored between blocks, so a task never holds more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.buckets import runs_of
from tallyguard.llm.models import tidy
from tallyguard.operators.materialise import materialise

Q = 8
EDIT_SHARE = 0.1
BLOCK_CHARS = 4_000_000
CHARS_AT_ONCE = 1 << 19
ALIGNED_AT_ONCE = 128
_FILTER_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def even(text: str) -> str:
    """Case folded, white space runs as one space, none at the ends."""
    return " ".join(text.casefold().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    count = max(0, len(codes) - q + 1)
    value = np.zeros(count, np.uint64)
    for k in range(q):
        value = value * _MULTIPLIER + codes[k : k + count].astype(np.uint64) + np.uint64(1)
    return value


def edit_budget(length: int, q: int, share: float) -> int:
    """The edits allowed for an item: a share of its length for which the lemma still has a bound."""
    return max(0, min(int(share * length), (length - q) // q))


def banded_alignments(
    items: list[np.ndarray], regions: list[np.ndarray], first: list[int], last: list[int]
) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best occurrence of each item in its region, all at once.

    Only alignments whose diagonals (region place minus item place) stay from ``first`` to ``last``
    count. An occurrence may start and end anywhere; of equal ones the first start is taken.
    """
    one, far = 1 << 32, 1 << 60
    lengths = np.array([len(i) for i in items])
    limits = np.array([len(r) for r in regions])[:, None]
    widths = np.array(last) - np.array(first) + 1
    most, width = int(lengths.max()), int(widths.max())
    diagonals = np.array(first)[:, None] + np.arange(width)
    symbols = np.full((len(items), most), -2, np.int64)
    # symbols of the region from its first diagonal on, -1 outside
    around = np.full((len(items), width + most), -1, np.int64)
    for c, (item, region) in enumerate(zip(items, regions)):
        symbols[c, : len(item)] = item
        low, high = max(0, first[c]), min(len(region), first[c] + width + most)
        if low < high:
            around[c, low - first[c] : high - first[c]] = region[low:high]
    in_band = np.arange(width) < widths[:, None]
    # a cell holds edits * one + start, so that the smallest cell has the fewest edits
    row = np.where(in_band & (diagonals >= 0) & (diagonals <= limits), diagonals, far)
    steps = np.arange(width) * one
    for i in range(most):
        here = around[:, i : i + width]
        moved = np.where(here >= 0, row + one * (here != symbols[:, i : i + 1]), far)
        moved[:, :-1] = np.minimum(moved[:, :-1], row[:, 1:] + one)
        column = diagonals + i + 1
        moved[~in_band | (column < 0) | (column > limits)] = far
        moved = np.minimum.accumulate(moved - steps, axis=1) + steps
        row = np.where((lengths > i)[:, None], moved, row)
    row[~in_band] = far
    best = row.argmin(axis=1)
    cells = row[np.arange(len(items)), best]
    ends = diagonals[np.arange(len(items)), best] + lengths
    return [(int(c) // one, int(c) % one, int(e)) for c, e in zip(cells, ends)]


class Benchmark:
    """A block of items and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = EDIT_SHARE):
        self.q = q
        kept = [(number, even(text)) for number, text in items if text and even(text)]
        self.short = [(number, text) for number, text in kept if len(text) < q]
        kept = [pair for pair in kept if len(pair[1]) >= q]
        self.ids = [number for number, _ in kept]
        self.codes = [_codes(text) for _, text in kept]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        self.budgets = np.array([edit_budget(n, q, share) for n in sizes.tolist()], np.int64)
        self.bounds = np.maximum(1, sizes - q + 1 - q * self.budgets)
        grams = [_grams(c, q) for c in self.codes]
        values = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.first, self.count = runs_of(values[order])
        self.grams = values[order][self.first]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * _MULTIPLIER >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def _candidates(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, text, first diagonal) of the bands that hold enough shared q-grams.

        ``starts`` says where each text begins in ``codes``, and where the last one ends. Diagonals are
        those of the text, and q-grams do not reach from one text into the next.
        """
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.filter[self._slot(grams)])
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        text = np.searchsorted(starts, at, "right") - 1
        known = (self.grams[slot] == grams[at]) & (at + self.q <= starts[text + 1])
        at, slot, text = at[known], slot[known], text[known]
        count = self.count[slot]
        posting = np.arange(count.sum()) + np.repeat(self.first[slot] - (np.cumsum(count) - count), count)
        item, text = self.item[posting], np.repeat(text, count)
        diagonal = np.repeat(at, count) - starts[text] - self.place[posting]
        # a number for each pair of item and text that share anything
        pairs, pair = np.unique(item * len(starts) + text, return_inverse=True)
        items = pairs // len(starts)
        band = diagonal // (self.budgets[item] + 1)
        # bands of two widths, a width apart: any e + 1 neighbouring diagonals lie in one of them
        offset = 1 << 33
        keys = np.concatenate([band, band - 1]) + offset + (np.concatenate([pair, pair]) << 34)
        places = np.concatenate([posting, posting])
        order = np.argsort(keys)
        keys, places = keys[order], places[order]
        first, hits = runs_of(keys)
        enough = np.repeat(hits >= self.bounds[items[keys[first] >> 34]], hits)
        # of these, count each place of the item once
        found = np.unique(np.stack([keys[enough], self.place[places[enough]]], axis=1), axis=0)
        first, hits = runs_of(found[:, 0])
        keys = found[first, 0]
        enough = hits >= self.bounds[items[keys >> 34]]
        for key in keys[enough].tolist():
            number, text = divmod(int(pairs[key >> 34]), len(starts))
            yield number, text, ((key & ((1 << 34) - 1)) - offset) * (int(self.budgets[number]) + 1)

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each evened-out text its occurrences (item id, start, end, edits), without overlaps."""
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for number, text in self.short:
            for i, t in enumerate(texts):
                at = t.find(text)
                while at >= 0:
                    found[i].append((number, at, at + len(text), 0))
                    at = t.find(text, at + len(text))
        if not len(self.grams) or not texts:
            return found
        pieces = [_codes(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(piece) for piece in pieces])])
        codes = np.concatenate(pieces)
        hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        wanted = []
        for item, i, low in self._candidates(codes, starts):
            budget = int(self.budgets[item])
            wanted.append((len(self.codes[item]), item, i, low - budget, low + 3 * budget + 1))
        wanted.sort()
        for at in range(0, len(wanted), ALIGNED_AT_ONCE):
            some = wanted[at : at + ALIGNED_AT_ONCE]
            aligned = banded_alignments(
                [self.codes[item] for _, item, *_ in some],
                [pieces[i] for _, _, i, *_ in some],
                [first for *_, first, _ in some],
                [last for *_, last in some],
            )
            for (_, item, i, *_), (edits, start, end) in zip(some, aligned):
                if edits <= self.budgets[item]:
                    hits.setdefault((i, item), []).append((edits, start, end))
        for (i, item), spans in hits.items():
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(set(spans)):
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    found[i].append((self.ids[item], start, end, edits))
        return found


def _places(text: str) -> list[int]:
    """For each character of the evened-out text its place in ``text``, and the end."""
    places, words = [], 0
    at = 0
    for word in text.split():
        at = text.index(word, at)
        if words:
            places.append(at - 1)
        for k, c in enumerate(word):
            places += [at + k] * len(c.casefold())
        at += len(word)
        words += 1
    return [*places, len(text)]


def _matches(bench: Benchmark, texts: list[str]) -> list[list[dict]]:
    evened = [even(t) for t in texts]
    result: list[list[dict]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(evened[end]) <= CHARS_AT_ONCE):
            size += len(evened[end])
            end += 1
        for text, found in zip(texts[at:end], bench.find(evened[at:end])):
            places = _places(text) if found else []
            result.append(
                [
                    {"item_id": item, "start": places[a], "end": places[b - 1] + 1, "edits": edits}
                    for item, a, b, edits in sorted(found)
                ]
            )
        at = end
    return result


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of a bounded number of characters; the driver holds one block."""
    rows = benchmark.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def _searcher(block: Broadcast, at: int):
    """A function over batches of rows that adds the matches of one block of items to column ``at``.

    The last column is the text that is searched; it does not come out.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = block.value
        for batch in batches:
            *columns, texts = batch.columns
            found = _matches(bench, texts.to_pylist())
            earlier = columns[at].to_pylist()
            columns[at] = pa.array([a + b for a, b in zip(earlier, found)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return search


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    name: str = "matches",
) -> DataFrame:
    """All columns and rows of ``docs``, and an array of (item_id, start, end, edits).

    Places are characters of the text as it is. Null and empty texts match nothing, and neither do
    null or empty items; items that share a text, or repeat, are all reported. Without items the
    arrays are empty. A column of ``docs`` with the new name is replaced.
    """
    kind = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"
    rows = docs.withColumn(name, F.array().cast(kind))
    columns = rows.columns
    searched = False
    for items in _blocks(benchmark, item_col, item_text_col):
        if searched:
            # stored between blocks, so that tasks hold the index of one block at a time
            rows = materialise(rows)
        searched = True
        block = docs.sparkSession.sparkContext.broadcast(Benchmark(items))
        rows = rows.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("_searched")).mapInArrow(
            tidy(_searcher(block, columns.index(name))), rows.schema
        )
    return rows


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per occurrence: id, item_id, start, end, edits. Clean documents have none.

    Rows that repeat an id are searched each. Other columns of either table are not read.
    """
    texts = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    found = with_matches(texts, benchmark, "_text", item_col, item_text_col, "_m")
    return found.select(id_col, F.explode("_m").alias("m")).select(id_col, "m.*")
