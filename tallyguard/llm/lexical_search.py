"""Ranked lexical search for a set of items, by grouping documents by the terms they hold.

Two passes. The first one cuts every document into terms, next to the terms that the items ask for, and
stores what was found in blocks of documents: ids, lengths and the occurrences per term. The statistics
of the whole table come from all blocks. The second pass meets each block with every item: bitmaps of the
item's terms give each document a mask of the terms it holds, documents of one mask form a group, and the
groups are scored in the order of the most that a document of theirs can reach, until no further group
can reach the last place.

Items are a stated set of queries and are read in blocks of a bounded size. Texts are not shuffled; the
best few per item and task are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.llm import texts as tx
from tallyguard.llm.buckets import runs_of
from tallyguard.llm.copies import texts_by_id
from tallyguard.llm.models import tidy
from tallyguard.operators.materialise import materialise

DOCUMENTS_PER_BLOCK = 8192
BLOCK_CHARS = 4_000_000
CELLS_AT_ONCE = 1 << 22
SCORED_AT_ONCE = 64
_POSTINGS = "ids binary, lengths binary, starts binary, places binary, counts binary, documents long, terms long"
_UNIT = 1_000_000_000
# the two statistics that go along with the document counts of the terms
_DOCUMENTS, _TERMS = -1, -2


def _cut(content: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tx.words(content, starts, tx.NOT_IN_TERMS)


def _eight(content: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place to its end, as one number."""
    padded = np.concatenate([content, np.zeros(8, np.uint8)])
    every = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    number = every[at].copy().view("<u8").ravel()
    kept = np.minimum(8, end - at).astype(np.uint64)
    return number & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - kept) * np.uint64(8)))


def _names(content: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(hash, length, first bytes, last bytes) of every word; words of 16 bytes are told apart exactly."""
    tail = np.maximum(first, end - 8)
    return np.stack(
        [
            tx.SpanHashes(content)(first, end),
            (end - first).astype(np.uint64),
            _eight(content, first, end),
            _eight(content, tail, end),
        ]
    )


class Terms:
    """The distinct terms of a block of items, and which of them each item asks for."""

    def __init__(self, texts: list[str | None]):
        content, starts = tx.utf8(pa.array(texts, pa.string()))
        content = tx.LOWER[content]
        first, end, item = _cut(content, starts)
        names = _names(content, first, end)
        order = np.lexsort(names[::-1])
        names, item = names[:, order], item[order]
        new = np.ones(len(item), bool)
        new[1:] = (names[:, 1:] != names[:, :-1]).any(axis=0)
        self.names = names[:, new]
        number = np.cumsum(new) - 1
        pairs = np.unique(np.stack([item, number]), axis=1)
        self.of_item: list[np.ndarray] = [pairs[1, pairs[0] == i] for i in range(len(texts))]

    def __len__(self) -> int:
        return self.names.shape[1]

    def find(self, content: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the number of the term."""
        if not len(self) or not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = tx.SpanHashes(content)(first, end)
        slot = np.minimum(np.searchsorted(self.names[0], hashes), len(self) - 1)
        at = np.flatnonzero(self.names[0, slot] == hashes)
        found, slot = _names(content, first[at], end[at]), slot[at]
        # terms of one hash stand next to each other
        known = (self.names[:, slot] == found).all(axis=0)
        other = np.flatnonzero(~known)
        while len(other):
            slot[other] += 1
            other = other[slot[other] < len(self)]
            other = other[self.names[0, slot[other]] == found[0, other]]
            known[other] = (self.names[:, slot[other]] == found[:, other]).all(axis=0)
            other = other[~known[other]]
        return at[known], slot[known]


@dataclass
class _Waiting:
    """What was found in the documents of the block that is being filled."""

    ids: list[np.ndarray]
    lengths: list[np.ndarray]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rows: int = 0
    documents: int = 0
    terms: int = 0

    def row(self, vocabulary: int) -> pa.RecordBatch:
        """The block: documents with a term, and for each term the documents that hold it."""
        term, doc, count = (np.concatenate(c) for c in zip(*self.found))
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        kept, place = np.unique(doc, return_inverse=True)
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(vocabulary + 1))
        arrays = [ids[kept], lengths[kept], starts, place[order], count[order]]
        values = [*(a.astype(np.int64).tobytes() for a in arrays), self.documents, self.terms]
        kinds = [pa.binary()] * 5 + [pa.int64()] * 2
        names = [part.split()[0] for part in _POSTINGS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def _blocks(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
    """(id, t) -> blocks of documents."""
    block = _Waiting([], [], [])
    for batch in tx.parts(batches, 1):
        ids = batch.column(0).to_numpy()
        content, starts = tx.utf8(batch.column(1))
        content = tx.LOWER[content]
        first, end, text = _cut(content, starts)
        lengths = np.bincount(text, minlength=len(ids))
        at, term = terms.find(content, first, end)
        pairs, count = np.unique(text[at] * max(1, len(terms)) + term, return_counts=True)
        block.found.append((pairs % max(1, len(terms)), pairs // max(1, len(terms)) + block.rows, count))
        block.ids.append(ids)
        block.lengths.append(lengths)
        block.rows += len(ids)
        block.documents += int((lengths > 0).sum())
        block.terms += int(lengths.sum())
        if block.rows >= DOCUMENTS_PER_BLOCK:
            yield block.row(len(terms))
            block = _Waiting([], [], [])
    if block.rows:
        yield block.row(len(terms))


def _statistics(batches: Iterator[pa.RecordBatch], vocabulary: int) -> Iterator[pa.RecordBatch]:
    """(term, n): documents per term, and the two totals, of the blocks of a task."""
    total, holding = np.zeros(2, np.int64), np.zeros(vocabulary, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            total += [row["documents"], row["terms"]]
            holding += np.diff(np.frombuffer(row["starts"], np.int64))
    held = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([_DOCUMENTS, _TERMS, *held.tolist()], pa.int64()),
            pa.array([*total.tolist(), *holding[held].tolist()], pa.int64()),
        ],
        names=["term", "n"],
    )


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Search:
    """What a task needs to rank its blocks for all items of a block of items."""

    item_ids: list[int | None]
    of_item: list[np.ndarray]
    weights: np.ndarray
    documents: int
    terms: int
    top: int

    def length_part(self, lengths: np.ndarray) -> np.ndarray:
        """m of every document."""
        if int(lengths.max(initial=0)) * 90 * self.documents >= 1 << 63:
            exact = [10 + 90 * int(n) * self.documents // self.terms for n in lengths]
            return np.array(exact, np.int64)
        return 10 + 90 * lengths * self.documents // self.terms

    def best_of(
        self, block: dict, item: int, known: tuple[np.ndarray, np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the best documents so far, with those of this block."""
        terms = self.of_item[item]
        if not len(terms):
            return known
        wide = max(64, CELLS_AT_ONCE // len(terms))
        for low in range(0, len(block["ids"]), wide):
            known = self._best_of_range(block, terms, low, min(low + wide, len(block["ids"])), known)
        return known

    def _best_of_range(
        self, block: dict, terms: np.ndarray, low: int, high: int, known: tuple[np.ndarray, np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros((len(terms), high - low), np.int64)
        for i, term in enumerate(terms.tolist()):
            span = slice(block["starts"][term], block["starts"][term + 1])
            places = block["places"][span]
            if low or high < len(block["ids"]):
                inside = slice(*np.searchsorted(places, [low, high]))
                found[i, places[inside] - low] = block["counts"][span][inside]
            else:
                found[i, places] = block["counts"][span]
        ids, m, weights = block["ids"][low:high], block["m"][low:high], self.weights[terms]
        # a document's mask: one bit for each term of the item
        bits = np.packbits(found > 0, axis=0)
        bits = np.pad(bits, ((0, -len(bits) % 8), (0, 0)))
        masks = np.ascontiguousarray(bits.T).view("<u8")
        order = np.lexsort(masks.T)
        masks = masks[order]
        new = np.ones(len(order), bool)
        new[1:] = (masks[1:] != masks[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        # the most a document of the group can reach: the largest counts, the smallest length part
        held = np.unpackbits(masks[first].view(np.uint8), axis=1, count=len(terms)).astype(bool)
        most, least_m = found.max(axis=1, initial=0), np.minimum.reduceat(m[order], first)
        reach = weights * (_UNIT * most // (1000 * most + 8 * least_m[:, None]))
        reach = np.where(held, reach, 0).sum(axis=1)
        by_reach = np.argsort(-reach, kind="stable")
        ends, at, step = np.cumsum(size[by_reach]), 0, SCORED_AT_ONCE
        scores, best_ids = known
        while at < len(by_reach):
            # what the last place has now; below it, and below 1, no group counts
            bar = max(1, int(scores[self.top - 1])) if len(scores) >= self.top else 1
            open_groups = int(np.searchsorted(-reach[by_reach], -bar, "right"))
            until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step)) + 1
            until = min(until, open_groups)
            if until <= at:
                break
            groups = by_reach[at:until]
            rows = np.repeat(first[groups], size[groups]) + _within(size[groups])
            rows = order[rows]
            count = found[:, rows]
            exact = (weights[:, None] * (_UNIT * count // (1000 * count + 8 * m[rows]))).sum(axis=0)
            scores = np.concatenate([scores, exact[exact > 0]])
            best_ids = np.concatenate([best_ids, ids[rows][exact > 0]])
            kept = np.lexsort((best_ids, -scores))[: self.top]
            scores, best_ids = scores[kept], best_ids[kept]
            at, step = until, step * 2
        return scores, best_ids

    def rank(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, item_id, id, score): the best of the blocks of a task."""
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = [nothing for _ in self.of_item]
        for batch in batches:
            for row in batch.to_pylist():
                block = {k: np.frombuffer(v, np.int64) for k, v in row.items() if isinstance(v, bytes)}
                block["m"] = self.length_part(block["lengths"])
                if len(block["ids"]):
                    best = [self.best_of(block, item, known) for item, known in enumerate(best)]
        items = np.repeat(np.arange(len(best)), [len(scores) for scores, _ in best]).tolist()
        scores, ids = (np.concatenate([b[k] for b in best]) if best else nothing[0] for k in (0, 1))
        columns = [items, [self.item_ids[item] for item in items], ids, scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "id", "score"]
        )


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _search(
    spark: SparkSession, docs: DataFrame, item_ids: list[int | None], texts: list[str | None], top: int
) -> DataFrame:
    """(item, item_id, id, score, rank) for one block of items."""
    terms = spark.sparkContext.broadcast(Terms(texts))
    vocabulary = len(terms.value)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(batches, terms.value)

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _statistics(batches, vocabulary)

    stored = materialise(docs.mapInArrow(tidy(blocks), _POSTINGS))
    # one row for each term of the items, and two
    counts = stored.mapInArrow(tidy(statistics), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = {row["term"]: row["n"] for row in counts.collect()}
    total = known.get(_DOCUMENTS, 0)
    weights = np.array([weight(total, known.get(t, 0)) for t in range(vocabulary)], np.int64)
    search = spark.sparkContext.broadcast(
        Search(item_ids, terms.value.of_item, weights, total, known.get(_TERMS, 0), top)
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search.value.rank(batches)

    ranked = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return (
        stored.mapInArrow(tidy(rank), "item long, item_id long, id long, score long")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
    )


def _item_blocks(items: DataFrame) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """The items in blocks of a bounded number of characters; the driver holds one block."""
    ids, texts, size = [], [], 0
    for number, text in items.toLocalIterator():
        if ids and size + len(text or "") > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(number)
        texts.append(text)
        size += len(text or "") + 64
    if ids:
        yield ids, texts


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = 10,
) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``top`` documents of every item, scores above 0 only.

    Every row of ``docs`` is a document and every row of ``items`` an item, repeated ids included. Null
    and empty texts have no terms; an item without terms, or whose terms no document holds, has no
    answers. Equal scores come by id, a null id first. Empty tables give no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    texts = texts_by_id(docs, id_col, text_col)
    result = None
    for ids, item_texts in _item_blocks(items.select(F.col(item_col).cast("long"), item_text_col)):
        # stored, so that blocks of items do not pile up in one plan
        found = materialise(_search(spark, texts, ids, item_texts, top))
        result = found if result is None else result.union(found)
    if result is None:
        return spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    null_id = F.lit(-(1 << 63))
    return result.select(
        F.col("item_id").alias(item_col), "rank", F.nullif("id", null_id).alias(id_col), "score"
    )
