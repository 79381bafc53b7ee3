from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyguard.llm import packing
from tallyguard.llm.packing import Encoder, best_fit, cut_points, pack, pack_documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids + [0]
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_encoder(library):
    encode = Encoder(TOKENIZER)
    rnd = random.Random(2)
    alphabet = [*"abc  \n\t.,'s019é漢🙂\xa0\x1c　", "<|endoftext|>", "'ll ", " the"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    assert encode(texts) == [ids_of(library, t)[:-4] for t in texts]


def test_cut_points():
    assert list(cut_points(1, 4)) == [(0, 1)]
    assert list(cut_points(4, 4)) == [(0, 4)]
    assert list(cut_points(9, 4)) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = best_fit([7, 6, 3, 4, 10], 10)
    assert sorted(fill) == [10, 10, 10]
    assert bins[0] == bins[2] and bins[1] == bins[3]
    assert offsets[2] == 7


def checked(rows, library, texts, capacity):
    """Pieces rebuild their texts; sequences have no gaps and fit."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = Counter()
    for doc_id, text in texts:
        ids = ids_of(library, text)
        for number, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
            piece = ids[4 * start : 4 * (start + length)]
            wanted[doc_id, number, start, length, zlib.crc32(piece)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    return len(by_sequence)


def test_whole_table(documents, library):
    rows = pack_documents(documents.repartition(5), TOKENIZER).collect()
    sequences = checked(rows, library, [(r.doc_id, r.text) for r in documents.collect()], 2048)
    assert sequences <= -(-sum(r.length for r in rows) // 2048) + 2


def test_edge_cases(edge_docs, edge_rows, library, no_docs):
    found = pack_documents(edge_docs, TOKENIZER, with_ids=True)
    assert found.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    checked(found.collect(), library, [(i, t) for i, t, _ in edge_rows], 2048)
    assert pack_documents(no_docs, TOKENIZER).count() == 0


def test_many_levels(spark, monkeypatch):
    # more partitions than one level joins, and items that leave every bin underfull
    sizes = [(i, 30 + i % 45) for i in range(400)]
    pieces = spark.createDataFrame(sizes, "doc_id long, length long").repartition(70)
    rows = pack(pieces, 100, fan_in=4).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sizes
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 100
    assert sum(f <= 50 for f in fills.values()) <= 1


def test_bound_of_a_group_keeps_all_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "CARRIED", 2)
    pieces = spark.createDataFrame([(i, 60) for i in range(50)], "doc_id long, length long").repartition(10)
    assert len({r.sequence_id for r in pack(pieces, 100).collect()}) == 50
