from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallyguard.llm import jaccard_join
from tallyguard.llm.components import components
from tallyguard.llm.jaccard_join import similar_documents, unit_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def classes(nodes, edges):
    """The smallest node each one is connected with."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def expected(rows):
    sets = [(-1 if i is None else i, shingles(t)) for i, t, *_ in rows]
    edges = [
        (a, b)
        for x, (a, s) in enumerate(sets)
        for b, t in sets[:x]
        if s and t and 100 * len(s & t) >= 85 * len(s | t)
    ]
    label = classes({i for i, _ in sets}, edges)
    return sorted((i, len(s), label[i]) for i, s in sets)


def found(docs):
    rows = similar_documents(docs).collect()
    number = lambda i: -1 if i is None else i
    return sorted((number(r.doc_id), r.n_shingles, number(r.component_id)) for r in rows)


def test_edges_are_made_once(spark):
    # a chain over several partitions: what makes its edges must not run again for the other direction
    runs = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    chain = spark.range(0, 400, numPartitions=4).selectExpr("id AS a", "id + 1 AS b")
    found = components(chain.mapInArrow(make, "a long, b long")).collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(401)}
    assert runs.value == 400


def test_unit_against_all_pairs():
    rnd = random.Random(3)
    for _ in range(150):
        sets = []
        for _ in range(rnd.randint(2, 30)):
            near = set(rnd.choice(sets)) if sets and rnd.random() < 0.7 else set(rnd.sample(range(200), rnd.randint(1, 30)))
            for _ in range(rnd.randint(0, 3)):
                near.discard(rnd.choice(sorted(near or {0})))
                near.add(rnd.randint(0, 200))
            sets.append(near)
        sets.sort(key=len)
        sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
        links = unit_links(sizes, tokens, np.concatenate([[0], np.cumsum(sizes)]), 85)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        assert {(max(p), min(p)) for p in links} <= set(pairs)
        assert classes(range(len(sets)), links) == classes(range(len(sets)), pairs)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in rows} == classes(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# normal limits; every list long; units so small that all are dealt into parts
@pytest.mark.parametrize(("short_list", "unit"), [(16, 2_000_000), (1, 2_000_000), (16, 300)])
def test_hot_groups(hot_docs, monkeypatch, short_list, unit):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(jaccard_join, "UNIT_SHINGLES", unit)
    assert found(hot_docs) == expected([(r.doc_id, r.text) for r in hot_docs.collect()])


def test_borderline_similarities(spark):
    # sets whose similarity is just at, above and below the limit
    words = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words))] + [(i, " ".join(words[:-i] if i % 2 else words[i:])) for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == expected(rows)


def test_edge_cases(edge_docs, edge_rows, no_docs):
    got = similar_documents(edge_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(edge_docs) == expected(edge_rows)
    assert similar_documents(no_docs).count() == 0
