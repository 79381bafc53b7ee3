from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece

from tallyguard.llm.token_counts import PieceCounter, merged_length, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_merges_by_rank():
    ranks = {"a": 9, "b": 9, "ab": 1, "ba": 0, "bab": 2}
    # the lowest pair is the second one, then "a" + "ba"
    assert merged_length("aba", ranks) == 1 + 1
    assert merged_length("babb", ranks) == 2
    assert merged_length("abab", {"a": 9, "b": 9, "ab": 1}) == 2
    assert merged_length("é", ranks) == 2


def test_random_texts(library):
    counter = PieceCounter(MODEL, remembered=50)
    rnd = random.Random(1)
    alphabet = [*"abcthe  \n\t.,;<s>▁_0129½²éß漢🙂̀\xa0　\x00", "</s>", "<0x0A>", "<unk>", "the "]
    for _ in range(1500):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert counter(text) == len(library.encode(text)), text


def test_whole_table(documents, library):
    found = {r.doc_id: r for r in token_counts(documents, MODEL, 500).collect()}
    for row in documents.collect():
        tokens = len(library.encode(row.text))
        assert tuple(found[row.doc_id])[1:] == (len(row.text.encode()), tokens, tokens > 500)


def test_edge_cases(edge_docs, edge_rows, library, no_docs):
    found = token_counts(edge_docs, MODEL, 4096)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = []
    for doc_id, text, _ in edge_rows:
        tokens = len(library.encode(text or ""))
        wanted.append((doc_id, len((text or "").encode()), tokens, tokens > 4096))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    assert token_counts(no_docs, MODEL, 4096).count() == 0
