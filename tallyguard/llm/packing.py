"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its own pieces by best fit, longest first. Bins that are nearly full are final.
The others are items of the next round: the bins of some neighbouring partitions meet in one group,
are packed by best fit as whole items, and what is still underfull goes one level up the tree, until
one group is left. Of a group's underfull bins the ``CARRIED`` emptiest go up; the fuller ones become
final as they are, so a group above the first level holds at most ``FAN_IN * CARRIED`` bins. At the first
level it holds the underfull bins of ``FAN_IN`` partitions. A partition packs ``LOCAL_ITEMS`` pieces at a
time; bins of two such runs meet in the tree only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.models import held, tidy
from tallyguard.operators.materialise import materialise

CAPACITY = 2048
NEARLY_FULL = 31 / 32
FAN_IN = 8
CARRIED = 4096
LOCAL_ITEMS = 200_000
TEXTS_AT_ONCE = 256
REMEMBERED_BYTES = 40 << 20
WORDS_AT_ONCE = 4096
_ADJACENT_SPACE = re.compile(r"\s\s")
# How byte-level pre-tokenisation cuts a text, and the printable characters it writes bytes as:
# fixed values of that format.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers, under a byte-level tokenizers file.

    The ids are those of the tokenizers library. A text is cut before every space that stands
    between two other characters, where pre-tokenisation always cuts, and the ids of such words are
    remembered. New words go through a rank table made from the file's vocabulary, many at once.
    Texts with adjacent white space or a special token in them are given to the library as they are.
    """

    def __init__(self, tokenizer_file: str):
        import os

        # Spark's tasks are the parallelism
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        before = self.tokenizer.pre_tokenizer
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.by_word = (
            self.tokenizer.normalizer is None
            and isinstance(before, pre_tokenizers.ByteLevel)
            and before.use_regex
            and not before.add_prefix_space
        )
        if self.by_word:
            byte_of = _byte_of()
            ranks = {
                bytes(byte_of[c] for c in token): number
                for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items()
                if token not in self.special
            }
            self.ranked = tiktoken.Encoding(
                "ranked", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}
            )
            (self.line_end,) = self.ranked.encode_ordinary("\n")
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _ranked(self, text: str) -> bytes:
        return np.array(self.ranked.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of a space and each word. A line end between two words is a token."""
        plain = [w for w in words if w and "\n" not in w and not w[-1].isspace()]
        for at in range(0, len(plain), WORDS_AT_ONCE):
            some = plain[at : at + WORDS_AT_ONCE]
            ids = np.array(self.ranked.encode_ordinary(" " + "\n ".join(some)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids)) * 4
            if len(ends) != len(some):
                break
            content, start = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist()):
                self.words[word] = content[start:end]
                start = end + 4
        for word in words:
            if word not in self.words:
                self.words[word] = self._ranked(" " + word)
        self.held += sum(map(len, words)) * 2 + 200 * len(words)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.held > REMEMBERED_BYTES:
            self.words, self.held = {}, 0
        cut: list[list[str] | None] = []
        for text in texts:
            odd = not self.by_word or _ADJACENT_SPACE.search(text) or any(s in text for s in self.special)
            cut.append(None if odd else text.split(" "))
        self._learn(list(set().union(*(words[1:] for words in cut if words)).difference(self.words)))
        get = self.words.__getitem__
        return [
            self._whole(text)
            if words is None
            else b"".join([self._ranked(words[0]), *map(get, words[1:])])
            for text, words in zip(texts, cut)
        ]


def encoder(tokenizer_file: str) -> Encoder:
    """One encoder per worker process."""
    return held(("encoder", tokenizer_file), lambda: Encoder(tokenizer_file))


def cut_points(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` tokens; only the first one may be shorter."""
    first = total % capacity or capacity
    yield 0, first
    for start in range(first, total, capacity):
        yield start, capacity


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Each text as ids and an end id, in pieces of at most ``capacity`` tokens.

    Columns: id, piece, start, length, ids_crc32, and on request ``ids`` (little-endian unsigned
    32-bit numbers). A null text counts as empty and is the end id alone.
    """
    texts, cut, schema = _cutting(docs, tokenizer_file, end_id, capacity, id_col, text_col, with_ids)
    return texts.mapInArrow(tidy(cut, model=True), schema)


def _cutting(docs, tokenizer_file, end_id, capacity, id_col, text_col, with_ids):
    """The texts, the work on their batches and the schema of what it gives."""
    fields = ["piece int", "start long", "length long", "ids_crc32 long"] + ["ids binary"] * with_ids
    key = docs.select(F.col(id_col).alias(id_col)).schema[0]
    schema = f"`{id_col}` {key.dataType.simpleString()}, {', '.join(fields)}"
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows = [], [], [], [], [], []
                for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += end
                    for number, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        for values, value in zip(
                            rows, (key, number, start, length, zlib.crc32(own), own)
                        ):
                            values.append(value)
                kinds = part.schema[0].type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
                names = id_col, "piece", "start", "length", "ids_crc32", "ids"
                n = 5 + with_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(rows[:n], kinds)], names=list(names[:n])
                )

    texts = docs.select(
        F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return texts, cut, schema


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: the bin and the offset of every item, and the fill of every bin."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    fill: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        with_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets, fill


_PLACED = "node int, bin long, offset long, fill long"


def _packing(capacity: int):
    """The work that adds node, bin, offset and the bin's fill; bins are those of one partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        first, waiting, count = node << 33, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            table = pa.Table.from_batches(waiting)
            bins, offsets, fill = best_fit(table.column("length").to_pylist(), capacity)
            table = table.append_column("node", pa.array([node] * len(bins), pa.int32()))
            table = table.append_column("bin", pa.array([first + b for b in bins], pa.int64()))
            table = table.append_column("offset", pa.array(offsets, pa.int64()))
            table = table.append_column("fill", pa.array([fill[b] for b in bins], pa.int64()))
            first += len(fill)
            yield from table.to_batches()

        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= LOCAL_ITEMS:
                yield from packed()
                waiting, count = [], 0
        if count:
            yield from packed()

    return pack


_LEVEL = "node int, bin long, fill long, members array<struct<bin:long,shift:long>>, final boolean"


def _merge_level(open_bins: DataFrame, fan_in: int, capacity: int, root: bool) -> DataFrame:
    """Best fit over the underfull bins of ``fan_in`` nodes, which become the items."""

    def merge(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin", kind="stable")
        sizes, members = bins["fill"].tolist(), bins["members"].tolist()
        names = bins["bin"].tolist()
        place, offsets, fill = best_fit(sizes, capacity)
        joined: list[list[dict]] = [[] for _ in fill]
        name = [-1] * len(fill)
        for i, b in enumerate(place):
            name[b] = max(name[b], names[i])
            joined[b] += [{"bin": m["bin"], "shift": m["shift"] + offsets[i]} for m in members[i]]
        waiting = [b for b, f in enumerate(fill) if f < NEARLY_FULL * capacity and not root]
        carried = set(sorted(waiting, key=lambda b: (fill[b], name[b]))[:CARRIED])
        return pd.DataFrame(
            {
                "node": int(bins["node"].iloc[0]),
                "bin": name,
                "fill": fill,
                "members": joined,
                "final": [b not in carried for b in range(len(fill))],
            }
        )

    parents = open_bins.withColumn("node", F.expr(f"node div {fan_in}").cast("int")).drop("final")
    return parents.groupBy("node").applyInPandas(merge, _LEVEL)


def pack(pieces: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` up to ``capacity``.

    Sequences have no gaps. Equal pieces are packed like any others; no pieces, no sequences.
    """
    schema = pieces.schema.simpleString()[7:-1]
    return _merged(pieces.mapInArrow(tidy(_packing(capacity)), f"{schema}, {_PLACED}"), capacity, fan_in)


def _merged(placed: DataFrame, capacity: int, fan_in: int = FAN_IN) -> DataFrame:
    """The bins of all partitions, merged up the tree."""
    placed = materialise(placed)
    first_of_bin = placed.filter(
        (F.col("offset") == 0) & (F.col("fill") < NEARLY_FULL * capacity)
    )
    member = F.array(F.struct(F.col("bin").alias("bin"), F.lit(0).cast("long").alias("shift")))
    open_bins = first_of_bin.select("node", "bin", "fill", member.alias("members"))
    widest = placed.agg(F.max("node")).first()[0]
    nodes = 0 if widest is None else widest + 1
    moved = []
    while nodes:
        nodes = -(-nodes // fan_in)
        level = materialise(_merge_level(open_bins, fan_in, capacity, root=nodes == 1))
        moved.append(level.filter("final").select(F.col("bin").alias("to"), F.explode("members").alias("m")))
        open_bins = level.filter("NOT final")
        nodes = 0 if nodes == 1 else nodes
    if not moved:
        return placed.withColumn("sequence_id", F.col("bin")).drop("node", "bin", "fill")
    moves = reduce(DataFrame.union, moved).select(F.col("m.bin").alias("bin"), "to", "m.shift")
    return (
        placed.join(moves, "bin", "left")
        .withColumn("sequence_id", F.coalesce("to", "bin"))
        .withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
        .drop("node", "bin", "fill", "to", "shift")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """All texts in as few sequences of at most ``capacity`` tokens as best fit finds.

    One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Only texts longer
    than a sequence are cut. Null and empty texts are one token; repeated rows are packed each; a
    null id stays null. Other columns are not read.
    """
    texts, cut, schema = _cutting(docs, tokenizer_file, 0, capacity, id_col, text_col, with_ids)
    pack_pieces = _packing(capacity)

    def cut_and_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one worker does both
        yield from pack_pieces(cut(batches))

    placed = texts.mapInArrow(tidy(cut_and_pack, model=True), f"{schema}, {_PLACED}")
    columns = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return _merged(placed, capacity).select(*columns, *["ids"] * with_ids)
