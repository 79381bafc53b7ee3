from __future__ import annotations

import random
import tracemalloc

import numpy as np

from tallyguard.llm import decontamination
from tallyguard.llm.decontamination import (
    EDIT_SHARE,
    Q,
    Benchmark,
    _matches,
    banded_alignments,
    contaminations,
    edit_budget,
    even,
    with_matches,
)


def codes(text):
    return np.array([ord(c) for c in text], np.uint32)


def fewest_edits(item: str, text: str) -> int:
    """The edit distance of an item to the nearest part of a text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1))
    return min(row)


def test_alignment_against_the_full_table():
    rnd = random.Random(1)
    items = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 20))) for _ in range(100)]
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(100)]
    found = banded_alignments([codes(i) for i in items], [codes(t) for t in texts], [-30] * 100, [60] * 100)
    for item, text, (edits, start, end) in zip(items, texts, found):
        assert edits == fewest_edits(item, text)
        assert fewest_edits(item, text[start:end]) == edits


def edited(rnd, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(letters))
        step = rnd.randrange(3)
        if step == 0:
            letters[at] = rnd.choice("xyz")
        elif step == 1:
            del letters[at]
        else:
            letters.insert(at, rnd.choice("xyz"))
    return "".join(letters)


def test_search_against_the_full_table():
    rnd = random.Random(2)
    alphabet = "abcdefghij klmn"
    for _ in range(60):
        items = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(40, 110)))) for i in range(3)]
        bench = Benchmark(items)
        texts = []
        for _ in range(4):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 150)))
            passage = edited(rnd, rnd.choice(items)[1], rnd.randint(0, 14))
            texts.append(rnd.choice([text, text[:50] + " " + passage.upper() + "\n" + text[50:], passage]))
        for text, found in zip(texts, _matches(bench, texts)):
            for number, item in items:
                best = fewest_edits(even(item), even(text))
                own = [m for m in found if m["item_id"] == number]
                assert bool(own) == (best <= edit_budget(len(even(item)), Q, EDIT_SHARE))
                for m in own:
                    part = even(text[m["start"] : m["end"]])
                    assert fewest_edits(even(item), part) == m["edits"]
                if own:
                    assert min(m["edits"] for m in own) == best


def test_whole_table(spark, documents, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: even(r.text) for r in benchmark.collect()}
    texts = {r.doc_id: even(r.text) for r in documents.collect()}
    found = {(r.doc_id, r.item_id) for r in contaminations(documents, benchmark).collect()}
    exact = {(d, i) for d, t in texts.items() for i, item in items.items() if item in t}
    assert exact and exact <= found


def test_edge_cases(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    passage = next(t for i, t, _ in edge_rows if i == 14)
    items = [(1, passage[:200]), (2, None), (3, ""), (4, "漢字 🙂"), (5, passage[:200]), (None, "one two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = {(1, 1), (1, 5), (9, 1), (9, 5), (14, 1), (14, 5), (4, 4), (5, 4), (11, None), (12, None)}
    for block in (4_000_000, 10):
        # the benchmark as one block, and an item at a time
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
        rows = contaminations(edge_docs, benchmark).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == wanted
        assert len(rows) == len(wanted) + 2  # document 9 is there twice
    assert contaminations(no_docs, benchmark).count() == 0
    assert contaminations(edge_docs, benchmark.limit(0)).count() == 0
    assert with_matches(edge_docs, benchmark).columns == edge_docs.columns


def test_short_items_are_found_everywhere():
    bench = Benchmark([(1, "ab"), (2, "c d")])
    [found] = _matches(bench, ["AB x ab abab c  d"])
    assert [(m["item_id"], m["start"], m["end"]) for m in found] == [(1, 0, 2), (1, 5, 7), (1, 8, 10), (1, 10, 12), (2, 13, 17)]


def test_texts_next_to_each_other_stay_apart():
    rnd = random.Random(5)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(80)).strip()
    bench = Benchmark([(1, item)])
    # halves of an item at the end of one text and the start of the next one are no occurrence
    for cut in (20, 40, 60):
        assert _matches(bench, ["x" * 30 + item[:cut], item[cut:] + "y" * 30]) == [[], []]
    assert [len(m) for m in _matches(bench, [item, "", item + " " + item, "x"])] == [1, 0, 2, 0]


def test_a_long_item_and_many_short_texts():
    rnd = random.Random(6)
    item = " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(20_000))
    bench = Benchmark([(1, item)])
    texts = [item[at : at + 15] for at in range(0, 100_000, 10)]
    tracemalloc.start()
    found = _matches(bench, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not any(found) and peak < 300 << 20
    [whole] = _matches(bench, ["before " + item[:60_000] + "edited" + item[60_000:]])
    assert [(m["item_id"], m["edits"]) for m in whole] == [(1, 6)]
