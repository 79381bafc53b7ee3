from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms_of(text):
    return [m.group().translate(LOWER) for m in TERM.finditer(text or "")]


def expected(documents, items, top=10):
    """(item, rank, document, score) by scoring every document for every item."""
    counted = [(i, Counter(terms_of(t))) for i, t in documents]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, count in counted:
            if not count:
                continue
            m = 10 + 90 * sum(count.values()) * n_docs // total
            score = 0
            for term in set(terms_of(text)):
                if count[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[term] + 1)))
                    score += w * (10**9 * count[term] // (1000 * count[term] + 8 * m))
            if score > 0:
                scored.append((-score, -math.inf if doc is None else doc, doc, score))
        scored.sort(key=lambda s: s[:2])
        rows += [(item, rank + 1, doc, score) for rank, (_, _, doc, score) in enumerate(scored[:top])]
    return sorted(rows, key=str)


def corpus(count, seed, vocabulary=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 20))) for _ in range(vocabulary)]
    common = words[:4]
    texts = []
    for _ in range(count):
        n = rnd.randint(0, 30)
        texts.append(" ".join(rnd.choice(common if rnd.random() < 0.5 else words) for _ in range(n)))
    return list(enumerate(texts)), words


def run(spark, documents, items, **names):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("id", "t", "score", "rank", "item_id", "item")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    return sorted((tuple(r) for r in ls.ranked_search(docs, asked).collect()), key=str)


def test_equals_scoring_every_document(spark):
    documents, words = corpus(700, 1)
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.sample(words, rnd.randint(1, 12))).upper()) for i in range(12)]
    # more terms than a machine word has bits
    many, more = corpus(50, 3, vocabulary=300)
    items.append((99, " ".join(words + more)))
    documents += [(1000 + i, t + " " + words[0]) for i, t in many]
    assert run(spark, documents, items) == expected(documents, items)


def test_edge_cases(spark, edge_rows):
    documents = [(i, t) for i, t, _ in edge_rows]
    # equal scores, more of them than there are places, a null id among them
    documents += [(100 - i, "tie word here") for i in range(14)] + [(None, "tie word here")]
    items = [(1, "Tie"), (1, "ünïcode 漢字 one"), (2, None), (3, ""), (4, " ,.;@[`{"), (None, "one two three")]
    items += [(5, documents[0][1]), (6, documents[6][1]), (7, "no such term anywhere zzzzzz"), (8, "1234-5678")]
    assert run(spark, documents, items) == expected(documents, items)


def test_hot_terms_and_copies(spark, hot_docs):
    documents = [(r.doc_id, r.text) for r in hot_docs.collect()]
    items = [(i, documents[i][1]) for i in range(0, 90, 9)]
    assert run(spark, documents, items) == expected(documents, items)


def test_empty_tables(spark, no_docs):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ls.ranked_search(no_docs, benchmark).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ls.ranked_search(docs, benchmark.limit(0)).count() == 0
    assert ls.ranked_search(docs.withColumn("text", F.lit(None).cast("string")), benchmark).count() == 0


@pytest.mark.parametrize("cells", [1, 1 << 22])
def test_many_blocks_in_a_task(monkeypatch, cells):
    monkeypatch.setattr(ls, "DOCUMENTS_PER_BLOCK", 32)
    monkeypatch.setattr(ls, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(ls, "SCORED_AT_ONCE", 2)
    documents, words = corpus(300, 7)
    items = [(i, " ".join(words[i : i + 6])) for i in range(0, 40, 5)]
    terms = ls.Terms([t for _, t in items])
    ids, texts = zip(*documents)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(ids[a : a + 10]), pa.array(texts[a : a + 10])], names=["id", "t"])
        for a in range(0, 300, 10)
    ]
    blocks = list(ls._blocks(iter(batches), terms))
    assert len(blocks) > 5
    rows = [r for batch in ls._statistics(iter(blocks), len(terms)) for r in batch.to_pylist()]
    known = {r["term"]: r["n"] for r in rows}
    weights = np.array([ls.weight(known[-1], known.get(t, 0)) for t in range(len(terms))])
    search = ls.Search([i for i, _ in items], terms.of_item, weights, known[-1], known[-2], 10)
    found = [r for batch in search.rank(iter(blocks)) for r in batch.to_pylist()]
    best = sorted(((r["item_id"], -r["score"], r["id"]) for r in found))
    wanted = sorted((item, -score, doc) for item, _, doc, score in expected(documents, items))
    assert best == wanted


def test_words_of_equal_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(ls.tx.SpanHashes, "__call__", lambda self, a, b: np.zeros(len(a), np.uint64) + np.uint64(7))
    terms = ls.Terms(["alpha beta gamma", "beta delta"])
    assert len(terms) == 4 and [len(t) for t in terms.of_item] == [3, 2]
    content = np.frombuffer(b"delta omega beta", np.uint8)
    at, term = terms.find(content, np.array([0, 6, 12]), np.array([5, 11, 16]))
    assert at.tolist() == [0, 2] and set(term) == set(terms.of_item[1])
