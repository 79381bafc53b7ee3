from __future__ import annotations

import zlib
from collections import defaultdict

from tallyguard.llm.sharding import edited_map, load_map, new_map, save_map, shard_documents


def checked(found, rows, shards):
    got = found.collect()
    wanted = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == wanted
    places, sizes = defaultdict(list), [0] * shards
    for r in got:
        assert (r.law, r.grown_shard) == ("bytes", None)
        places[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for slots in places.values():
        assert sorted(slots) == list(range(len(slots)))
    return sizes


def test_whole_table(spark, documents, tmp_path):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    sizes = checked(shard_documents(documents, 24, str(tmp_path)), rows, 24)
    largest = max(len(t.encode()) + 8 for _, t in rows)
    assert max(sizes) - min(sizes) <= largest


def test_edge_cases(edge_docs, edge_rows, no_docs, tmp_path):
    found = shard_documents(edge_docs, 3, str(tmp_path / "a"), slots=64)
    checked(found, [(i, t) for i, t, _ in edge_rows], 3)
    assert shard_documents(no_docs, 3, str(tmp_path / "b")).count() == 0


def test_maps_are_versions(spark, tmp_path):
    totals = [(slot, 100 + slot % 7, 2) for slot in range(400)]
    first = new_map(totals, 8)
    save_map(spark, first, str(tmp_path))
    # one shard more: slots only move into it, and as many as it needs
    second = edited_map(first, totals, 9)
    save_map(spark, second, str(tmp_path))
    assert {r.version for r in load_map(spark, str(tmp_path), 1).collect()} == {1}
    assert {r.version for r in load_map(spark, str(tmp_path), 2).collect()} == {2}
    before, after = ({r[1]: r[2] for r in m} for m in (first, second))
    moved = [slot for slot in before if before[slot] != after[slot]]
    assert {after[slot] for slot in moved} == {8}
    assert 400 / 9 * 0.8 < len(moved) < 400 / 9 * 1.2
    sizes = [sum(r[3] for r in second if r[2] == shard) for shard in range(9)]
    assert max(sizes) <= sum(sizes) / 9 * 1.02
    # a shard less: only its slots have to move
    third = edited_map(second, totals, 8)
    stay = {slot for slot in after if after[slot] < 8}
    now = {r[1]: r[2] for r in third}
    assert all(shard < 8 for shard in now.values())
    assert sum(now[slot] == after[slot] for slot in stay) >= 0.95 * len(stay)
    assert {r[0] for r in third} == {3}
