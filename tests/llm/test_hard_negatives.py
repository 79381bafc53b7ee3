from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyguard.llm.hard_negatives import CoverTree, hard_negatives, whole_components

KIND = "vec_id long, embedding array<double>, label int, score string, anchor int, v int"


def expected(rows, every=50, scale=256):
    """(anchor, positive, rank, negative, scores) by comparing all rows."""
    usable = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((i, [math.floor(scale * x) for x in vector], label))
    found = []
    for i, a, label in usable:
        if i % every:
            continue
        scored = [
            (sum(x * y for x, y in zip(a, b)), j, other == label) for j, b, other in usable if j != i
        ]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p][:3]
            found += [(i, j, rank + 1, k, p, n) for rank, (n, k, _) in enumerate(fits)]
    return sorted(found)


def run(spark, rows, every=50, parts=4):
    frame = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], KIND).repartition(parts)
    found = hard_negatives(frame, F.col("vec_id") % every == 0)
    return sorted(tuple(r) for r in found.collect())


def vectors(count, width, labels, seed, clusters=0):
    rnd = np.random.default_rng(seed)
    points = rnd.normal(size=(count, width)) / math.sqrt(width)
    if clusters:
        points = points * 0.2 + rnd.normal(size=(clusters, width))[rnd.integers(0, clusters, count)]
    return [(i, p.tolist(), int(rnd.integers(0, labels))) for i, p in enumerate(points)]


@pytest.mark.parametrize("width,clusters,labels", [(16, 0, 4), (3, 0, 2), (4, 12, 3)])
def test_equals_all_pairs(spark, width, clusters, labels):
    rows = vectors(900, width, labels, width + clusters, clusters)
    found = run(spark, rows)
    assert found and found == expected(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = vectors(300, 2, 3, 5)
    # coarse components: many equal scores
    rows = [(i, [round(x, 1) for x in v], label) for i, v, label in rows]
    rows += [(None, [0.1, 0.2], 1), (400, None, 1), (401, [None, 0.5], 1), (402, [math.nan, 0.5], 1)]
    rows += [(450, [math.inf, 0.5], 1), (500, [0.5, 0.5], None), (50, *rows[50][1:]), (7, *rows[7][1:])]
    rows += [(550, [0.4], 2), (551, [], 1), (552, [0.4, 0.1, 9.0], 1)]
    assert run(spark, rows) == expected(rows)


def test_hot_label_and_copies(spark):
    rnd = random.Random(3)
    rows = [(i, [0.5, 0.25, rnd.choice([0.0, 0.5])], 0 if i % 3 else i % 7) for i in range(700)]
    assert run(spark, rows, parts=2) == expected(rows)


def test_large_components_are_exact(spark):
    rows = vectors(120, 3, 2, 9)
    rows = [(i, [x * 1e6 for x in v], label) for i, v, label in rows]
    assert run(spark, rows, every=10) == expected(rows, every=10)


def test_without_rows_or_anchors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_tree_covers_its_points():
    rows = vectors(1500, 5, 1, 2, clusters=9)
    points = whole_components(pa.array([v for _, v, _ in rows]), 256)
    tree = CoverTree.build(0, np.arange(1500), points)
    wide = points.astype(float)
    extra = np.sqrt(np.maximum(0, tree.longest - (wide**2).sum(axis=1)))
    wide = np.column_stack([wide, extra])
    seen = []

    def below(number, centre):
        node = tree.nodes[number]
        reached = []
        for point, radius, child in zip(node.points, node.radius, node.below):
            under = below(child, point) if child >= 0 else [point]
            gaps = np.linalg.norm(wide[under] - wide[point], axis=1)
            assert gaps.max() <= radius + 1e-3 and point in under
            reached += under
        return reached

    seen = below(0, -1)
    assert sorted(seen) == list(range(1500))
    assert len(tree.nodes) > 10


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    found = hard_negatives(table, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == expected(rows)
