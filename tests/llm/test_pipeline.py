from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tallyguard.llm.decontamination import even
from test_jaccard_join import expected as similar
from test_jaccard_join import shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reread(spark, frame, path):
    frame.write.parquet(str(path))
    return spark.read.parquet(str(path))


def stages(spark, docs, sf_dir, tmp_path):
    """The kept rows after every stage but the last, and the last one's result."""
    kept = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        result = reread(spark, stage(spark, docs, sf_dir), tmp_path / str(i))
        if i < len(pipeline.STAGES) - 1:
            assert result.columns == docs.columns
            kept.append([(r.doc_id, r.text) for r in result.collect()])
        docs = result
    return kept, docs


def model(rows, items):
    """The kept rows after every stage, by brute force."""
    result = [[(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]]
    groups = {}
    for i, t in result[-1]:
        groups.setdefault(t.translate(LOWER), []).append(i)
    largest = {t: max(ids, key=lambda i: (i is not None, i)) for t, ids in groups.items()}
    unique = {(largest[t.translate(LOWER)], t.translate(LOWER)) for _, t in result[-1]}
    result.append(unique)
    # every row by itself, in the order in which rows of a class stay
    rows = sorted(unique, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    label = {i: c for i, _, c in similar([(n, t) for n, (_, t) in enumerate(rows)])}
    result.append([row for n, row in enumerate(rows) if label[n] == n])
    result.append([(i, t) for i, t in result[-1] if not any(item in even(t) for item in items)])
    return [sorted((str(i), t.translate(LOWER)) for i, t in rows) for rows in result]


def test_whole_table(spark, documents, sf_dir, tmp_path):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    items = [even(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept, packed = stages(spark, documents, sf_dir, tmp_path)
    assert [sorted((str(i), t.translate(LOWER)) for i, t in part) for part in kept] == model(rows, items)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in kept[-1]}
    assert len(kept[0]) > len(kept[1]) > len(kept[2]) > len(kept[3])


def test_edge_cases(spark, edge_docs, edge_rows, sf_dir, tmp_path):
    kept, packed = stages(spark, edge_docs, sf_dir, tmp_path)
    wanted = model([(i, t) for i, t, _ in edge_rows], [])
    assert [sorted((str(i), t.translate(LOWER)) for i, t in part) for part in kept] == wanted
    assert all(shingles(t) for _, t in kept[-1])
    assert packed.count() >= len(kept[-1])


def test_missing_labels_are_filled_in(spark, documents, sf_dir):
    docs = documents.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    found = pipeline.keep_known_languages(spark, docs, sf_dir)
    assert found.filter("lang is null").count() == 0


def test_near_copies_by_five_words(spark, sf_dir):
    # one changed word in fifty: 0.804 by five words, 0.843 by four
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words), "en"), (2, " ".join([*words[:25], "changed", *words[26:]]), "en"), (3, "some other text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in pipeline.keep_one_of_similar_texts(spark, docs, sf_dir).collect()} == {1, 3}


def test_rows_of_one_id_are_judged_each(spark, sf_dir):
    words = [f"w{i}" for i in range(50)]
    near = " ".join([*words[:25], "changed", *words[26:]])
    rows = [(1, " ".join(words), "en"), (14, near, "en"), (14, "a text of its own", "en"), (14, None, "en"), (14, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = pipeline.keep_one_of_similar_texts(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, str(r.text)) for r in found) == sorted(
        (i, str(t)) for i, t, _ in rows if t != near
    )


def test_without_any_label(spark, sf_dir):
    rows = [(1, "some words", None), (2, None, None), (3, "12 -- 3", None), (None, "others", None), (4, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = pipeline.keep_known_languages(spark, docs, sf_dir)
    assert found.columns == docs.columns
    assert {tuple(r) for r in found.collect()} == {(1, "some words", None), (None, "others", None)}


def test_empty_table(spark, no_docs, sf_dir, tmp_path):
    kept, packed = stages(spark, no_docs, sf_dir, tmp_path)
    assert kept == [[], [], [], []] and packed.count() == 0


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run
    assert [name for name in entry.queries() if name.startswith("op")] == [
        "op1_packing", "op2_token_counts", "op3_decontamination", "op4_ngram_jaccard", "op5_exact_dedup",
        "op6_language_id", "op7_html_extraction", "op8_sharding", "op9_suffix_dedup", "op10_substring_dedup",
        "op11_license_scan", "op12_lexical_search", "op13_hard_negatives",
    ]
