"""Token counts by byte-pair merging over a heap and a linked list, without making identifiers.

The symbols of a segment form a doubly linked list; a heap holds the adjacent pairs that are a piece
of the vocabulary, by rank and then by place. The lowest pair is popped and merged again and again.
The count is the number of initial symbols minus the merges, where a character that is no piece
counts as its UTF-8 bytes.

A text is first cut into segments over whose borders no piece can reach; the vocabulary is checked
for that when it is read, and texts stay whole for a vocabulary that fails the check. Counts of
segments are remembered in a table of bounded size, which changes the time and never the result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.models import held

SPACE = "▁"
# raised digits and fractions, which \w takes for letters
NUMBERS = "²³¹¼½¾"
LETTERS, OTHERS = rf"[^\W\d_{NUMBERS}]+", rf"(?:\d|[_{NUMBERS}]|[^\w{SPACE}])+"
SEGMENT = re.compile(rf"{SPACE}*{LETTERS}|{SPACE}*{OTHERS}|{SPACE}+")
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


class Remembered(dict):
    """Key -> count, computed when first asked for; forgets everything when it is full."""

    def __init__(self, compute: Callable[[str], int], size: int):
        super().__init__()
        self.compute = compute
        self.size = size

    def __missing__(self, key: str) -> int:
        count = self.compute(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= self.size:
                self.clear()
            self[key] = count
        return count


def merged_length(segment: str, ranks: dict[str, int]) -> int:
    """The number of tokens of one segment."""
    size = len(segment)
    if size == 1 or segment in ranks and size == 2:
        return 1 if segment in ranks else len(segment.encode("utf-8", "replace"))
    symbols: list[str] = list(segment)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    rank_of = ranks.get
    heap = []
    for i in range(size - 1):
        pair = symbols[i] + symbols[i + 1]
        rank = rank_of(pair)
        if rank is not None:
            heap.append((rank, i, pair))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, pair = pop(heap)
        j = after[i]
        if not symbols[i] or j >= size or symbols[i] + symbols[j] != pair:
            continue
        symbols[i] = pair
        symbols[j] = ""
        k = after[i] = after[j]
        if k < size:
            before[k] = i
            right = pair + symbols[k]
            rank = rank_of(right)
            if rank is not None:
                push(heap, (rank, i, right))
        h = before[i]
        if h >= 0:
            left = symbols[h] + pair
            rank = rank_of(left)
            if rank is not None:
                push(heap, (rank, h, left))
    return sum(
        1 if s in ranks else len(s.encode("utf-8", "replace")) for s in symbols if s
    )


class PieceCounter:
    """Counts the tokens of whole texts under a sentencepiece model of byte-pair type."""

    def __init__(self, model_file: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ranks = {}
        for i in range(self.model.get_piece_size()):
            if self.model.is_unused(i):
                raise ValueError("pieces marked as unused are not supported")
            if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i):
                continue
            ranks[self.model.id_to_piece(i)] = -self.model.get_score(i)
        self.segmented = all(len(SEGMENT.findall(piece)) == 1 for piece in ranks)
        self.ranks = ranks
        self.segments = Remembered(lambda s: merged_length(s, ranks), remembered)
        self.words = Remembered(lambda word: self._by_segment(SPACE + word), remembered)

    def _by_segment(self, normal: str) -> int:
        return sum(map(self.segments.__getitem__, SEGMENT.findall(normal)))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        normal = self.model.normalize(text)
        if not self.segmented:
            return merged_length(normal, self.ranks)
        if normal[0] != SPACE or normal[-1] == SPACE or SPACE * 2 in normal:
            return self._by_segment(normal)
        # each word has exactly one space sign before it, and a segment never reaches into two words
        return sum(map(self.words.__getitem__, normal[1:].split(SPACE)))


def piece_counter(model_file: str) -> PieceCounter:
    """One counter per worker process, which all its tasks share."""
    return held(("counter", model_file), lambda: PieceCounter(model_file))


def token_counts(
    docs: DataFrame,
    model_file: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, without special tokens.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give a row
    each; texts of any length are counted whole. Other columns are not read. ``model_file`` has to
    be readable on every worker.
    """

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = piece_counter(model_file)
        for texts in parts:
            yield pd.Series([counter(t) for t in texts], dtype="int64")

    return docs.select(
        F.col(id_col).alias(id_col),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        count(F.col(text_col)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
