"""Connected components of an edge table, with joins and aggregations only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyguard.llm.models import tidy
from tallyguard.operators.materialise import materialise

EDGES_AT_ONCE = 500_000


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) edges as stars around the smallest node of what is connected among those at hand."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(find(x), x) for x in root]
        a, b = zip(*(p for p in pairs if p[0] != p[1])) if any(r != x for r, x in pairs) else ((), ())
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    seen = 0
    for batch in batches:
        for a, b in zip(*(column.to_pylist() for column in batch.columns)):
            one, two = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(one, two)] = min(one, two)
        seen += batch.num_rows
        if seen >= EDGES_AT_ONCE:
            yield stars()
            seen = 0
    if root:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): the smallest node that can be reached.

    Every task first turns its own edges into stars, which leaves fewer edges and shorter paths. Each
    round then takes the smallest label of all neighbours and the label of that label, until nothing
    changes. Sums and minima combine before the shuffle; labels that own many nodes are on
    the side of a join that can be split.
    """
    edges = edges.select("a", "b").mapInArrow(tidy(forests), "a long, b long")
    # both directions from one reading, so that what makes the edges runs once
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(edges.select(F.explode(turned).alias("e")).select("e.a", "e.b").distinct())
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("component")
        )
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lowered = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("c")
        )
        above = lowered.select(F.col("node").alias("c"), F.col("c").alias("above"))
        # the changes are counted while the labels are written, so a round is a single job
        seen = Observation()
        labels = materialise(
            lowered.join(above, "c", "left")
            .select("node", "old", F.coalesce(F.least("c", "above"), "c").alias("component"))
            .observe(seen, F.count_if(F.col("component") != F.col("old")).alias("changes"))
            .select("node", "component")
        )
        if not seen.get["changes"]:
            return labels
