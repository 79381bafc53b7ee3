"""Exact Jaccard join of word-shingle sets, and the classes that its links make.

Sets are ordered lists of shingle hashes, in one order for all: shingles that are frequent in the
corpus come last. From the sizes of two sets follows how many of their leading shingles they have to
share to be able to link. Index lists of shingles that few sets lead with give counts: first of every
set with the head of each of its lists, which connects most of what belongs together, and then of the
pairs in a list that this has not connected yet. Of the longer lists only their number per set is needed
to keep the bound exact, and sets that could link through them alone are joined to the list's first set.
Sets that these candidates connect form a unit, and each set travels to its unit once.

Inside a unit, sets are sorted by size, and each shingle has the list of the places of its sets. For
a set, the lists give its overlap with all others; places of sets that are too large or too small are
skipped as blocks of the list. A set that is much like the one computed before takes over its
overlaps, and only the lists of shingles in which the two differ are read. Links leave a unit as
stars around the smallest id, which have the same classes.

Units of more than ``UNIT_SHINGLES`` shingles are dealt into salted parts, and every two parts meet in a
unit of their own, so that no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm import texts as tx
from tallyguard.llm.buckets import bucket_count, runs_of
from tallyguard.llm.components import components
from tallyguard.llm.copies import NULL_ID
from tallyguard.llm.models import tidy
from tallyguard.llm.shared import shared_keys
from tallyguard.operators.materialise import materialise

SHINGLE_WORDS = 4
THRESHOLD = 85
SKETCH_CELLS = 1 << 19
SKETCH_SLICES = 32
UNIT_SHINGLES = 1_000_000
# index lists up to this length are turned into pairs
SHORT_LIST = 16
KEY_BYTES = 5


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)


def _counted(hashes: np.ndarray) -> np.ndarray:
    """Only shingles in the lower half of the hash range can come early in the order."""
    return hashes < np.uint64(1 << 63)


def frequency_classes(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """A class from 0 (rare) to 15 for each of a fixed number of cells of shingles.

    Every shingle of every text is counted. The result has SKETCH_CELLS bytes whatever the input;
    any classes make a correct order, these make a short one.
    """
    width = SKETCH_CELLS // SKETCH_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_CELLS, np.int64)
        for part in tx.parts(batches, 0):
            content, starts = tx.utf8(part.column(0))
            _, hashes, _ = tx.word_shingles(tx.LOWER[content], starts, size)
            cells += np.bincount(_cell(hashes[_counted(hashes)]), minlength=SKETCH_CELLS)
        if cells.any():
            counts = pa.array([c.tobytes() for c in cells.reshape(SKETCH_SLICES, width)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SKETCH_SLICES), pa.int32()), counts], names=["slice", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())],
            names=["slice", "counts"],
        )

    schema = "slice int, counts binary"
    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(tidy(count), schema)
    total = np.zeros((SKETCH_SLICES, width), np.int64)
    for row in counted.repartition("slice").mapInArrow(tidy(add), schema).collect():
        total[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    total = total.ravel()
    usual = 4 * max(4.0, float(total.mean()))
    return np.clip(np.floor(np.log2(np.maximum(total / usual, 0.5))) + 1, 0, 15).astype(np.uint8)


def ordered_tokens(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Shingles as positive 63-bit numbers whose order is (frequency class, hash)."""
    kind = np.where(_counted(hashes), classes[_cell(hashes)], 0).astype(np.uint64)
    return (kind << np.uint64(59)) | (hashes >> np.uint64(5))


def _sets_of(part: pa.RecordBatch, classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ordered sets of a batch of texts, one after the other, and where each one starts."""
    content, starts = tx.utf8(part.column(1))
    text, hashes, _ = tx.word_shingles(tx.LOWER[content], starts, size)
    text, tokens = tx.distinct_in_groups(text, ordered_tokens(hashes, classes))
    return tokens, np.searchsorted(text, np.arange(part.num_rows + 1))


def leading(n: int, threshold: int) -> int:
    """How many leading shingles of a set of ``n`` are looked at.

    Of two linked sets, one of the first n - ceil(t n) + 1 would have to be shared; a twentieth more
    makes it a twentieth more that have to be.
    """
    return n - -(-threshold * n // 100) + 1 + n // 20


def _sizes(docs: DataFrame, classes, size: int) -> DataFrame:
    """(id, n, d1, d2): the size and two digests of each set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.parts(batches, 1):
            tokens, bounds = _sets_of(part, classes.value, size)
            sums = [np.append(np.uint64(0), np.cumsum(tx.mix(tokens, seed))) for seed in (11, 12)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    *(pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums),
                ],
                names=["id", "n", "d1", "d2"],
            )

    return docs.mapInArrow(tidy(measure), "id long, n long, d1 long, d2 long")


def _index(docs: DataFrame, classes, size: int, threshold: int) -> DataFrame:
    """(token, id): the index lists of leading shingles that several rows have."""

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in tx.parts(iter([batch]), 1):
            tokens, bounds = _sets_of(part, classes.value, size)
            lead = np.array([leading(n, threshold) if n else 0 for n in np.diff(bounds).tolist()], np.int64)
            ends = np.cumsum(lead)
            take = np.arange(lead.sum()) + np.repeat(bounds[:-1] - (ends - lead), lead)
            yield np.repeat(part.column(0).to_numpy(), lead), tokens[take]

    shared = shared_keys(docs, keys_of, bucket_count(docs), KEY_BYTES, flat=True)
    return shared.select(F.col("key").alias("token"), "id")


def _candidates(index: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): edges that connect all sets that may link. ``sets`` has (id, n), distinct sets only."""
    index = index.join(sets.select("id"), "id").select("token", "id").distinct()
    lists = index.groupBy("token").agg(F.count("*").alias("sets"), F.min("id").alias("head")).filter("sets > 1")
    is_long = (F.col("sets") > SHORT_LIST).alias("is_long")
    listed = materialise(index.join(lists, "token").select("token", "id", "head", is_long))
    short, long = listed.filter("NOT is_long"), listed.filter("is_long")
    in_long = long.groupBy("id").agg(F.count("*").alias("in_long"))
    facts = materialise(sets.select("id", "n").join(in_long, "id", "left").fillna(0, ["in_long"]))

    lead = {s: f"(n{s} - (({threshold} * n{s} + 99) div 100) + 1 + (n{s} div 20))" for s in "ab"}
    overlap = f"(({threshold} * (na + nb) + {99 + threshold}) div {100 + threshold})"
    may_link = (
        f"100 * least(na, nb) >= {threshold} * greatest(na, nb)"
        f" AND common + least(la, lb) >= least({lead['a']} - na, {lead['b']} - nb) + {overlap}"
    )

    # of the pairs that meet in index lists, those that share enough of them to be able to link
    with_heads = materialise(
        short.filter("head < id")
        .groupBy(F.col("head").alias("a"), F.col("id").alias("b"))
        .agg(F.count("*").alias("common"))
        .join(facts.toDF("a", "na", "la"), "a")
        .join(facts.toDF("b", "nb", "lb"), "b")
        .filter(may_link)
        .select("a", "b")
    )
    # sets of one label are connected through the head that gave it
    labels = with_heads.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
    labelled = materialise(
        short.join(facts, "id")
        .join(labels, "id", "left")
        .select("token", "id", "n", "in_long", F.coalesce("label", "id").alias("label"))
    )
    # two sets that can link and are not connected yet have different labels in all lists they share
    mixed = (
        labelled.groupBy("token")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low < high")
        .select("token")
    )
    open_lists = labelled.join(mixed, "token")
    met = (
        open_lists.toDF("token", "a", "na", "la", "label_a")
        .join(open_lists.toDF("token", "b", "nb", "lb", "label_b"), "token")
        .filter("a < b AND label_a != label_b")
        .groupBy("a", "b", "na", "la", "nb", "lb")
        .agg(F.count("*").alias("common"))
    )
    pairs = with_heads.union(met.filter(may_link).select("a", "b"))
    # a set links through long lists alone only if it has enough of them
    by_long = long.join(facts.filter(f"in_long >= 1 + ({threshold} * n) div 2000").select("id"), "id")
    heads = materialise(by_long.groupBy("token").agg(F.min("id").alias("a")))
    stars = by_long.join(heads, "token").filter("a < id").select("a", F.col("id").alias("b")).distinct()
    return pairs.union(stars)


def _units(members: DataFrame) -> DataFrame:
    """(id, unit, n) -> (id, parts): the unit of each set; large ones have parts that meet in pairs."""
    sizes = members.groupBy("unit").agg(F.sum("n").alias("total"))
    parts = F.ceil(F.col("total") / UNIT_SHINGLES).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = members.join(sizes, "unit").withColumn("parts", parts).withColumn("own", own)
    meeting = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(
            "unit", F.least("own", other).alias("i"), F.greatest("own", other).alias("j")
        ),
    )
    return dealt.select("id", meeting.alias("units"))


def unit_links(sizes: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A forest over the links of all sets of a unit, as pairs of places; sets come by size."""
    order = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first, length = runs_of(tokens[order])
    # index lists of shingles that several sets have: the places of their sets, in order
    several = length > 1
    list_of = np.full(len(tokens), -1)
    list_of[order] = np.repeat(np.where(several, np.cumsum(several) - 1, -1), length)
    places = owner[order]
    starts, ends = first[several], first[several] + length[several]
    root = list(range(len(sizes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def overlaps(lists: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the lists hold each place from low to high; other places are skipped."""
        blocks = []
        for a, b in zip(starts[lists].tolist(), ends[lists].tolist()):
            block = places[a:b]
            if low > block[0] or high <= block[-1]:
                block = block[np.searchsorted(block, low) : np.searchsorted(block, high)]
            blocks.append(block)
        if not blocks:
            return np.zeros(high - low, np.int64)
        return np.bincount(np.concatenate(blocks) - low, minlength=high - low)

    links = []
    base: set[int] = set()
    base_counts, base_low, base_high = np.zeros(0, np.int64), 0, 0
    for x in range(len(sizes)):
        n = int(sizes[x])
        own = list_of[bounds[x] : bounds[x + 1]]
        own = own[own >= 0]
        # later sets are as large or larger, up to n / threshold
        high = int(np.searchsorted(sizes, 100 * n // threshold, "right"))
        low = x + 1
        if low >= high or not len(own):
            continue
        now = set(own.tolist())
        gone, new = base - now, now - base
        if len(gone) + len(new) < len(now) and base_low <= low and high <= base_high:
            counts = base_counts[low - base_low : high - base_low].copy()
            counts += overlaps(np.array(sorted(new), np.int64), low, high)
            counts -= overlaps(np.array(sorted(gone), np.int64), low, high)
        else:
            # a new base, over all places that sets of nearly its size can ask for
            reach = int(np.searchsorted(sizes, 115 * n // threshold, "right"))
            base, base_low, base_high = now, low, max(high, reach)
            base_counts = overlaps(own, base_low, base_high)
            counts = base_counts[: high - low]
        linked = np.flatnonzero(100 * counts >= threshold * (n + sizes[low:high] - counts)) + low
        for y in linked.tolist():
            a, b = find(x), find(y)
            if a != b:
                root[b] = a
                links.append((x, y))
    return links


def stars(ids: np.ndarray, links: list[tuple[int, int]]) -> np.ndarray:
    """Pairs of the smallest id of every class of linked places and each other id of it."""
    neighbours: dict[int, list[int]] = {}
    for x, y in links:
        neighbours.setdefault(x, []).append(y)
        neighbours.setdefault(y, []).append(x)
    pairs, done = [], set()
    for start in neighbours:
        if start in done:
            continue
        members, todo = [], [start]
        done.add(start)
        while todo:
            x = todo.pop()
            members.append(int(ids[x]))
            new = [y for y in neighbours[x] if y not in done]
            done.update(new)
            todo += new
        least = min(members)
        pairs += [(least, m) for m in members if m != least]
    return np.array(pairs, np.int64).reshape(-1, 2)


def _unit_edges(sets: DataFrame, threshold: int) -> DataFrame:
    """(unit, i, j, id, tokens) -> the classes of every unit as stars (a, b)."""

    def link(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], np.int64)
        sizes = np.array([len(r[1]) // 8 for r in rows])
        order = np.lexsort((ids, sizes))
        ids, sizes = ids[order], sizes[order]
        tokens = np.frombuffer(b"".join(rows[i][1] for i in order), np.uint64)
        links = unit_links(sizes, tokens, np.concatenate([[0], np.cumsum(sizes)]), threshold)
        pairs = stars(ids, links)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for *unit, owner, tokens in zip(*(column.to_pylist() for column in batch.columns)):
                if unit != now and len(rows) > 1:
                    yield link(rows)
                if unit != now:
                    now, rows = unit, []
                rows.append((owner, tokens))
        if len(rows) > 1:
            yield link(rows)

    unit = ["unit", "i", "j"]
    return sets.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(tidy(run), "a long, b long")


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    A text's set are its distinct shingles of ``shingle_words`` words (anything but white space),
    after lower-casing A-Z; a shorter text has its whole sequence, a null text or one without words
    has nothing and links with nothing. Two sets link when 100 |A and B| >= threshold |A or B|;
    component_id is the smallest id that links reach. Rows that repeat an id are one document for
    the links and come out each with its own size; a null id takes part as the smallest of all and
    stays null. Shingles and sets are told apart by 63- and 128-bit hashes. Other columns are not
    read, and texts of any length are read whole.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("t")
    )
    classes = spark.sparkContext.broadcast(frequency_classes(source, "t", shingle_words))
    rows = materialise(_sizes(source, classes, shingle_words))
    equal = ["n", "d1", "d2"]
    distinct_sets = materialise(rows.filter("n > 0").groupBy(*equal).agg(F.min("id").alias("id")))
    index = _index(source, classes, shingle_words, threshold)
    connected = components(_candidates(index, distinct_sets, threshold))
    members = connected.join(distinct_sets, connected["node"] == distinct_sets["id"]).select(
        "id", F.col("component").alias("unit"), "n"
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.parts(batches, 1):
            tokens, bounds = _sets_of(part, classes.value, shingle_words)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), tx.binaries(tokens, bounds)], names=["id", "units", "tokens"]
            )

    unit_type = "array<struct<unit:bigint,i:int,j:int>>"
    tokens_of = (
        source.join(_units(members), "id")
        .select("id", "t", "units")
        .mapInArrow(tidy(sets), f"id long, units {unit_type}, tokens binary")
        .select("id", "tokens", F.explode("units").alias("u"))
        .select("u.unit", "u.i", "u.j", "id", "tokens")
    )
    links = _unit_edges(tokens_of, threshold)
    # equal sets are linked through the smallest id that has the set
    smallest = distinct_sets.withColumnRenamed("id", "b")
    copies = rows.select("id", *equal).join(smallest, equal).select(F.col("id").alias("a"), "b")
    classes_of = components(links.union(copies))
    return (
        rows.select("id", "n")
        .join(classes_of.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.nullif("id", F.lit(NULL_ID)).alias(id_col),
            F.col("n").alias("n_shingles"),
            F.nullif(F.coalesce("component", "id"), F.lit(NULL_ID)).alias("component_id"),
        )
    )
