from __future__ import annotations

import random
import re
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyguard.llm.license_scan import license_scan
from tallyguard.llm.license_templates import NOTICES, PHRASES, TEMPLATES, Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(text, templates=TEMPLATES):
    """The row of a text, by comparing every run of words with every place of every template."""
    words = words_of(text)
    base, spans = [], []
    for template in templates:
        wanted = words_of(template.text)
        size = 2 if template.phrase else 4
        if template.phrase:
            for at in range(len(words) - len(wanted) + 1):
                if words[at : at + len(wanted)] == wanted:
                    base.append((at, template.label))
                    spans.append((template.label, at, at + len(wanted), 1.0))
            continue
        diagonals = defaultdict(list)
        places = defaultdict(list)
        for t in range(len(wanted) - size + 1):
            places[tuple(wanted[t : t + size])].append(t)
        for at in range(len(words) - size + 1):
            for t in places[tuple(words[at : at + size])]:
                diagonals[at - t].append(at)
        merged = []
        for first, diagonal, found in sorted((min(f), d, f) for d, f in diagonals.items()):
            covered = len({p + k for p in found for k in range(size)})
            end = max(found) + size
            reached = max((m[4] for m in merged), default=None)
            if merged and first - reached <= 12 and abs(diagonal - merged[-1][3]) <= 8:
                last = merged[-1]
                last[2] += max(0, covered - max(0, reached - first))
                last[1], last[3], last[4] = max(last[1], end), diagonal, max(last[4], end)
            else:
                merged.append([first, end, covered, diagonal, end])
        for first, end, covered, *_ in merged:
            score = min(1.0, covered / max(end - first, min(len(wanted), 16)))
            if score >= 0.8:
                spans.append((template.label, first, end, score))
    starts = [at for at, _ in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label for _, label in base})),
        ",".join(sorted({label for label, *_ in spans})),
        max((score for *_, score in spans), default=0.0),
        sorted(spans),
    )


def run(spark, rows, templates=TEMPLATES):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("id", "row", "t", "label", "score", "template", "span")})
    return [(r[0], *r[1:8], [tuple(s) for s in r.spans]) for r in license_scan(docs, templates=templates).collect()]


def check(spark, rows, templates=TEMPLATES):
    wanted = sorted(((i, *expected(t, templates)) for i, t in rows), key=str)
    assert sorted(run(spark, rows, templates), key=str) == wanted


def noise(rnd, count):
    return [rnd.choice(["the", "of", "license", "mit", "public", "general", "apache", "software", "x"]) for _ in range(count)]


def test_equals_comparing_all_places(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        words = noise(rnd, rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            notice = words_of(rnd.choice(TEMPLATES).text)
            for _ in range(rnd.randint(0, 1 + len(notice) // 8)):
                at = rnd.randrange(len(notice))
                notice[at : at + rnd.randint(0, 2)] = noise(rnd, rnd.randint(0, 2))
            words += notice + noise(rnd, rnd.randint(0, 20))
        rows.append((i, " ".join(words)))
    check(spark, rows)
    found = run(spark, rows)
    assert sum(bool(r[6]) and not r[5] for r in found) > 5 and sum(bool(r[5]) for r in found) > 40


def test_planted_notices_and_clean_texts(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(10_000 + i, f"some words before. {t.text} and after") for i, t in enumerate(NOTICES)]
    check(spark, rows)
    found = {r[0]: r for r in run(spark, rows)}
    for i, t in enumerate(NOTICES):
        assert t.label in found[10_000 + i][6].split(",") and found[10_000 + i][7] == 1.0
    for i, text in rows:
        if i < 10_000 and "licens" not in (text or "").lower():
            assert found[i][5:8] == ("", "", 0.0)


def test_edge_cases(spark, edge_rows):
    rows = [(i, t) for i, t, _ in edge_rows]
    rows += [(None, "MIT-License, mit license MIT\nLICENSE"), (20, "mit license " * 3000)]
    rows += [(21, "mit licensed submit license"), (21, "mit licensed submit license"), (22, "General Public")]
    rows += [(23, "mit"), (24, " ".join([NOTICES[9].text] * 40)), (25, "general public license version 3" * 5)]
    check(spark, rows)


def test_hot_notice(spark):
    check(spark, [(i, f"{i} words {NOTICES[i % 2 * 9].text}") for i in range(90)])


def test_empty_table_and_other_templates(spark, no_docs):
    assert license_scan(no_docs).count() == 0
    own = [Template("house", "our own rules apply here", True), Template("long", "a b c d e f g h")]
    rows = [(1, "Our own rules apply here!"), (2, "our own rules apply"), (3, "x a b c d e f g h"), (4, "a b c")]
    check(spark, rows, own)
    check(spark, rows, [])


def test_plan_reads_texts_once(documents):
    plan = license_scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1
