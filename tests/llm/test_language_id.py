from __future__ import annotations

import zlib

import numpy as np

from tallyguard.llm.language_id import (
    STRETCH,
    CrossParser,
    identify_languages,
    labelled_samples,
    suffix_automaton,
    with_language,
)


def phrases(text: bytes, sample: bytes) -> int:
    """Greedy longest phrases by direct search, each stretch on its own."""
    count = 0
    for at in range(0, len(text), STRETCH):
        phrase = b""
        for i in range(at, min(at + STRETCH, len(text))):
            byte = text[i : i + 1]
            if phrase + byte in sample:
                phrase += byte
            else:
                count += 1
                phrase = byte if byte in sample else b""
        count += 1
    return count


def test_automaton_accepts_the_substrings_only():
    text = b"abracadabra"
    arcs = suffix_automaton(text)
    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            state = 0
            for symbol in text[a:b]:
                state = arcs[state][symbol]
    state = 0
    for symbol in b"abra":
        state = arcs[state][symbol]
    assert ord("b") not in arcs[state]


def test_phrases_against_direct_search():
    samples = {"a": "the cat sat on the mat and the dog", "b": "el gato y el perro en la casa"}
    parser = CrossParser(samples)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"theca gost elprx"), int(n)).tolist()) for n in (1, 5, 40, 511, 512, 513, 1500)]
    found = parser.phrases(texts)
    for i, text in enumerate(texts):
        for j, lang in enumerate(parser.languages):
            assert found[i, j] == phrases(text, samples[lang].encode())


def test_many_classes_and_equal_languages():
    # more classes than a machine word has bits, and two languages of one sample
    text = "".join(chr(c) for c in range(33, 127)) + "äöüß漢字かな" + "the cat sat"
    parser = CrossParser({"b": text, "a": text, "c": "zz"})
    assert parser.words > 1
    found = parser.phrases([text.encode(), "cat 漢 zz~~".encode()])
    for i, t in enumerate([text.encode(), "cat 漢 zz~~".encode()]):
        for j, lang in enumerate(parser.languages):
            assert found[i, j] == phrases(t, {"a": text, "b": text, "c": "zz"}[lang].encode())
    # the first by name, with no lead
    assert parser.predict([text]) == (["a"], [0.0])


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = identify_languages(documents).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_only_the_text_decides(documents):
    samples = labelled_samples(documents)
    one = with_language(documents, samples).select("text", "lang_pred", "score").distinct()
    assert one.count() == documents.select("text").distinct().count()


def test_edge_cases(spark, edge_docs, no_docs):
    found = identify_languages(edge_docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == 17
    by_id = {r.doc_id: r for r in rows}
    for doc_id in (2, 3, 10, 13):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score) == ("und", 0.0)
    assert by_id[6].lang_pred in {"en", "de", "fr"}
    assert identify_languages(no_docs).count() == 0
    # nothing to learn from
    unlabelled = edge_docs.drop("lang").withColumn("lang", edge_docs["text"].substr(1, 0).cast("string"))
    unlabelled = unlabelled.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {"und"}


def test_repeated_rows_get_one_answer(edge_docs):
    rows = [tuple(r) for r in identify_languages(edge_docs).collect() if r.doc_id == 9]
    assert len(rows) == 2 and rows[0] == rows[1]
