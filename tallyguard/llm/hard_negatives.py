"""Hard negatives by exact inner product: a cover tree over norm-augmented candidates.

A vector x of a tree whose longest vector has length M gets one more coordinate, sqrt(M^2 - |x|^2), an
anchor gets 0 there; then |anchor - x|^2 = |anchor|^2 + M^2 - 2 (anchor . x), so the distance to a centre
and the covering radius of its level bound the inner products of all that lies below it from both sides.
Nodes are descended best bound first, those outside of every window are skipped, and whatever is reached
is scored exactly in integers.

Every partition builds trees of bounded size from its own rows, one label per tree, so candidates are
not shuffled and a label of any share is many trees. Anchors are a stated set of queries: they go out in
rounds of bounded size, and each round meets all trees where they are. Only the best few per anchor and
task are shuffled.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.buckets import runs_of
from tallyguard.llm.models import tidy
from tallyguard.operators.materialise import materialise

TREE_ROWS = 2048
LEAF_ROWS = 64
BASE = 1.3
ANCHORS_AT_ONCE = 512
CHILDREN_AT_ONCE = 256
OFFERS_AT_ONCE = 1 << 16
ROUND_BYTES = 32 << 20
# Whole numbers up to these are exact in floats and in doubles.
_EXACT = (float(1 << 24), np.float32), (float(1 << 53), np.float64)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_components(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; shorter vectors end in zeros. Python integers where needed."""
    sizes = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, int)
    flat = np.floor(scale * np.asarray(vectors.flatten(), dtype=np.float64))
    width = int(sizes.max(initial=0))
    dense = np.zeros((len(sizes), width))
    dense[np.arange(width) < sizes[:, None]] = flat
    if np.abs(dense).max(initial=0) < 1 << 31:
        return dense.astype(np.int32)
    return np.array([[int(x) for x in row] for row in dense], dtype=object).reshape(dense.shape)


def _numbers(points: np.ndarray, most: float) -> np.ndarray:
    """The same values in a type in which products of vectors up to the length ``most`` are exact."""
    for bound, kind in _EXACT:
        if most < bound:
            return points.astype(kind)
    return points.astype(object)


def _squares(points: np.ndarray) -> np.ndarray:
    wide = points.astype(np.float64)
    return np.einsum("ij,ij->i", wide, wide)


@dataclass
class _Node:
    """The points below one centre a level down, the radius around each, and the node of each."""

    points: np.ndarray
    radius: np.ndarray
    below: np.ndarray
    own: int = -1


@dataclass
class CoverTree:
    """Points in the order of their ids; node 0 holds the first level."""

    label: int
    ids: np.ndarray
    points: np.ndarray
    nodes: list[_Node] = field(default_factory=list)
    longest: float = 0.0

    @classmethod
    def build(cls, label: int, ids: np.ndarray, points: np.ndarray) -> CoverTree:
        order = np.argsort(ids, kind="stable")
        tree = cls(label, ids[order], points[order])
        squares = _squares(tree.points)
        tree.longest = float(squares.max(initial=0.0))
        wide = tree.points.astype(np.float64)
        extra = np.sqrt(tree.longest - squares)
        # distances in the space with the further coordinate, in which all points are equally long
        near = wide @ wide.T + np.outer(extra, extra)
        distance = np.sqrt(np.maximum(0.0, 2 * tree.longest - 2 * near))
        tree._add(distance, np.arange(len(ids)), -1)
        return tree

    def _add(self, distance: np.ndarray, members: np.ndarray, centre: int) -> int:
        """A node for ``members``; its centre, if it has one, is a member and a child of itself."""
        number = len(self.nodes)
        self.nodes.append(_Node(members, np.zeros(len(members)), np.full(len(members), -1), centre))
        if len(members) <= LEAF_ROWS:
            return number
        width = float(distance[members[0] if centre < 0 else centre, members].max())
        groups: list[np.ndarray] = []
        while width > 0:
            width /= BASE
            groups = self._cover(distance, members, centre, width)
            if len(groups) != 1:
                break
        if not groups:
            return number
        centres = np.array([group[0] for group in groups])
        radius = np.array([distance[group[0], group].max() for group in groups])
        below = np.array(
            [self._add(distance, np.sort(g), int(g[0])) if len(g) > 1 else -1 for g in groups]
        )
        by_id = np.argsort(centres)
        self.nodes[number] = _Node(centres[by_id], radius[by_id], below[by_id], centre)
        return number

    @staticmethod
    def _cover(distance: np.ndarray, members: np.ndarray, centre: int, width: float) -> list[np.ndarray]:
        """Groups within ``width`` of a first member each, which are further apart than that.

        None, where more than half of the members would stand alone: such a level separates nothing.
        """
        groups, rest = [], members
        if centre >= 0:
            rest = np.concatenate([[centre], members[members != centre]])
        while len(rest):
            inside = distance[rest[0], rest] <= width
            inside[0] = True
            groups.append(rest[inside])
            rest = rest[~inside]
            if 2 * len(groups) > len(members):
                return []
        return groups


class Best:
    """The best ``keep`` of every slot among what was offered: higher scores first, then smaller ids.

    ``bar`` is what a score must reach to count: the low end of the slot's window, or, once the slot is
    full, its last score. Offers are settled many at a time, so the bar may lag behind.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.keep, self.bar, self.high = keep, low.copy(), high
        nothing = np.zeros(0, np.int64)
        self.slot, self.score, self.id = nothing, nothing, nothing
        self.offers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.offers.append((slot, score.astype(object if score.dtype == object else np.int64), ids))
        self.waiting += len(slot)
        if self.waiting >= OFFERS_AT_ONCE:
            self.settle()

    def settle(self) -> None:
        slot, score, ids = (
            np.concatenate(c) for c in zip((self.slot, self.score, self.id), *self.offers)
        )
        self.offers, self.waiting = [], 0
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-score[order], kind="stable")]
        order = order[np.argsort(slot[order], kind="stable")]
        first, count = runs_of(slot[order])
        rank = np.arange(len(order)) - np.repeat(first, count)
        last = order[rank == self.keep - 1]
        self.bar[slot[last]] = score[last]
        order = order[rank < self.keep]
        self.slot, self.score, self.id = slot[order], score[order], ids[order]


def search(
    tree: CoverTree, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, best: Best, windows: int
) -> None:
    """Offers every point of ``tree`` that lies in a window of an anchor and can still count.

    Anchor ``rows[i]`` has the slots ``rows[i] * windows`` and following. A point with the id of the
    anchor is not offered to it.
    """
    width = min(points.shape[1], tree.points.shape[1])
    squares = _squares(points)
    most = max(tree.longest, float(squares.max(initial=0.0)))
    anchors, candidates = _numbers(points[:, :width], most), _numbers(tree.points[:, :width], most)
    # |anchor|^2 + M^2, and room for rounding
    total = squares + tree.longest
    slack = 1.0 + 1e-9 * total
    slots = rows[:, None] * windows + np.arange(windows)

    def open_rows(at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        mine = slots[at]
        return ((upper[:, None] >= best.bar[mine]) & (lower[:, None] <= best.high[mine])).any(axis=1)

    everything = np.full(len(rows), np.inf)
    pending = [(-np.inf, 0, 0, np.arange(len(rows)), everything, -everything)]
    pushed = 0
    while pending:
        *_, number, at, upper, lower = heapq.heappop(pending)
        at = at[open_rows(at, upper, lower)]
        if not len(at):
            continue
        node = tree.nodes[number]
        for start in range(0, len(node.points), CHILDREN_AT_ONCE):
            children = slice(start, start + CHILDREN_AT_ONCE)
            below = node.points[children]
            scores = anchors[at] @ candidates[below].T
            # between the least and the most that any window of the anchor takes
            least, most = best.bar[slots[at]].min(axis=1), best.high[slots[at]].max(axis=1)
            least, most = (x.astype(scores.dtype)[:, None] for x in (least, most))
            i, j = np.nonzero((scores >= least) & (scores <= most))
            countable = (below[j] != node.own) & (tree.ids[below[j]] != ids[at[i]])
            i, j = i[countable], j[countable]
            found, of_tree = scores[i, j], tree.ids[below[j]]
            for window in range(windows):
                mine = slots[at[i], window]
                inside = (found >= best.bar[mine]) & (found <= best.high[mine])
                if inside.any():
                    best.offer(mine[inside], found[inside], of_tree[inside])
            for j in np.flatnonzero(node.below[children] >= 0):
                wide = scores[:, j].astype(np.float64)
                distance = np.sqrt(np.maximum(0.0, total[at] - 2 * wide))
                radius = node.radius[start + j]
                most_below = (total[at] - np.maximum(0.0, distance - radius) ** 2) / 2 + slack[at]
                least_below = (total[at] - (distance + radius) ** 2) / 2 - slack[at]
                kept = open_rows(at, most_below, least_below)
                if kept.any():
                    pushed += 1
                    entry = (at[kept], most_below[kept], least_below[kept])
                    heapq.heappush(pending, (-entry[1].max(), pushed, int(node.below[start + j]), *entry))


def _planted(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(id, label, v) rows -> a row (label, tree) per tree."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[int, int] = {}

    def tree(label: int) -> pa.RecordBatch:
        ids, points = zip(*waiting.pop(label))
        width = max(p.shape[1] for p in points)
        same = [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in points]
        built = CoverTree.build(label, np.concatenate(ids), np.concatenate(same))
        del size[label]
        return pa.RecordBatch.from_arrays(
            [pa.array([label], pa.int64()), pa.array([pickle.dumps(built)], pa.binary())],
            names=["label", "tree"],
        )

    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        points = whole_components(batch.column(2), scale)
        order = np.argsort(labels, kind="stable")
        for first, count in zip(*runs_of(labels[order])):
            some, label = order[first : first + count], int(labels[order[first]])
            while len(some):
                room = TREE_ROWS - size.get(label, 0)
                waiting.setdefault(label, []).append((ids[some[:room]], points[some[:room]]))
                size[label] = size.get(label, 0) + len(some[:room])
                some = some[room:]
                if size[label] == TREE_ROWS:
                    yield tree(label)
    for label in list(waiting):
        yield tree(label)


@dataclass
class _Round:
    """The anchors of one round and, per anchor and window, the scores between which answers lie."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool
    keep: int

    def answers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, window, id, score): the best of the trees of this task."""
        windows = self.low.shape[1]
        best = Best(self.low.ravel(), self.high.ravel(), self.keep)
        for batch in batches:
            for label, packed in zip(*(column.to_pylist() for column in batch.columns)):
                rows = np.flatnonzero((self.labels == label) == self.same_label)
                found = pickle.loads(packed) if len(rows) else None
                for at in range(0, len(rows), ANCHORS_AT_ONCE):
                    some = rows[at : at + ANCHORS_AT_ONCE]
                    search(found, some, self.ids[some], self.points[some], best, windows)
                if best.waiting:
                    best.settle()
        columns = [best.slot // windows, best.slot % windows, best.id, best.score]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.tolist(), pa.int64()) for c in columns], names=["anchor", "window", "id", "score"]
        )


def _best_of_all(spark, trees: DataFrame, round_: _Round) -> DataFrame:
    """(anchor, window, id, score, rank) over the trees of all tasks."""
    held = spark.sparkContext.broadcast(round_)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from held.value.answers(batches)

    found = trees.mapInArrow(tidy(work), "anchor long, window long, id long, score long")
    ranked = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= round_.keep)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, exact.

    Scores are inner products of floor(scale * x). For each of an anchor's best ``positives`` rows of
    its label, the best ``negatives`` rows of other labels whose score lies between the two shares of the
    positive's score; ties go to the smaller id. Rows without id, label or vector, and those with a null
    component or one that is not finite after scaling, take no part. A row with the anchor's id is no
    partner of it; other repeated rows count each, and a repeated anchor has answers for each of its
    rows. A shorter vector counts as one that ends in zeros. Scores beyond 64 bits are an error. Other
    columns are not read; an empty table has no answers.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float("inf")))
    # NaN is larger than any number, so the comparison leaves it out as well
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        vector.alias("v"),
        is_anchor.alias("anchor"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & finite)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _planted(batches, scale)

    trees = materialise(
        rows.select("id", "label", "v").mapInArrow(tidy(plant), "label long, tree binary")
    )
    anchors = materialise(rows.filter("anchor").select("id", "label", "v"))
    size = anchors.agg(F.sum(F.size("v") * 8 + 64).alias("bytes")).first()["bytes"] or 0
    rounds = 1 + size // ROUND_BYTES
    result = None
    for turn in range(rounds):
        of_round = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn).toArrow().combine_chunks()
        if not of_round.num_rows:
            continue
        ids, labels = (of_round.column(k).to_numpy() for k in (0, 1))
        points = whole_components(pa.concat_arrays(of_round.column(2).chunks), scale)
        one = np.ones((len(ids), 1), np.int64)
        first = _Round(ids, labels, points, one * _LEAST, one * _MOST, True, positives)
        near = _best_of_all(spark, trees, first).toPandas()
        slots = near["anchor"].to_numpy(), near["rank"].to_numpy() - 1
        # no score lies between these
        low, high = np.full((len(ids), positives), _MOST), np.full((len(ids), positives), _LEAST)
        score = near["score"].astype(object)
        low[slots] = (-(-score * low_percent // 100)).to_numpy().astype(np.int64)
        high[slots] = (score * high_percent // 100).to_numpy().astype(np.int64)
        second = _Round(ids, labels, points, low, high, False, negatives)
        near["anchor_id"] = ids[slots[0]]
        partners = spark.createDataFrame(
            near.assign(window=slots[1])[["anchor", "window", "anchor_id", "id", "score"]],
            "anchor long, window long, anchor_id long, positive_id long, positive_score long",
        )
        # stored, so that rounds do not pile up in one plan
        found = materialise(
            _best_of_all(spark, trees, second)
            .join(F.broadcast(partners), ["anchor", "window"])
            .select(
                "anchor_id",
                "positive_id",
                "rank",
                F.col("id").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
        result = found if result is None else result.union(found)
    if result is None:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long"
        return spark.createDataFrame([], f"{kinds}, positive_score long, negative_score long")
    return result
