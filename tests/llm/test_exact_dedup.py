from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from tallyguard.llm.exact_dedup import exact_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    result = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda i: (i is not None, i)):
            now = i == keep and not kept
            kept = kept or now
            result.append((i, keep, len(ids), now, hashlib.sha256(text.encode()).hexdigest()))
    return result


def ordered(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_edge_cases(edge_docs, edge_rows, block):
    rows = edge_rows if block > 1 else [r for r in edge_rows if len(r[1] or "") < 2000]
    docs = edge_docs if block > 1 else edge_docs.filter("text is null or length(text) < 2000")
    found = exact_duplicates(docs, block_bytes=max(block, 7) if len(rows) == len(edge_rows) else block)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert ordered(found.collect()) == ordered(expected(rows))


def test_hot_group(hot_docs):
    rows = [(r.doc_id, r.text) for r in hot_docs.collect()]
    assert ordered(exact_duplicates(hot_docs, block_bytes=64).collect()) == ordered(expected(rows))


def test_empty_table(no_docs):
    assert exact_duplicates(no_docs).count() == 0


def test_plan_has_no_python(documents):
    plan = exact_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
