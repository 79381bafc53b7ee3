from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
# names that operators use for columns of their own
CLASHING = ["id", "row", "t", "n", "pos", "name", "first", "slot", "matches", "key", "component", "digest"]


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def frame(spark, rows):
    """(doc_id, text, lang) rows with every clashing column beside them."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.withColumns({c: F.lit(f"other {c}") for c in CLASHING}).repartition(3)


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, repeated rows, ties, near copies, multi-byte characters."""
    long_text = prose(1, 30_000)
    passage = prose(2, 80)
    return [
        (1, prose(3, 40) + " " + passage, "en"),
        (2, None, None),
        (3, "", "en"),
        (None, prose(4, 60), "en"),
        (4, "Ünïcode 漢字 🙂 Ab", "de"),
        (5, "ünïcode 漢字 🙂 aB", "de"),
        (6, long_text, "en"),
        (7, long_text.upper(), "en"),
        (8, long_text + " x", None),
        (9, prose(5, 30) + " " + passage + " " + prose(6, 30), "fr"),
        (9, prose(5, 30) + " " + passage + " " + prose(6, 30), "fr"),
        (10, "   \t\n ", "fr"),
        (11, "one two", "fr"),
        (12, "ONE  two", "fr"),
        (13, "1234 -- 5678", "en"),
        (14, passage, "en"),
        (14, "another text under the same number", "en"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return frame(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def hot_docs(spark):
    """A third of all rows are copies of one text, another third near copies of a second one."""
    base = prose(7, 120).split()
    rows = []
    rnd = random.Random(8)
    for i in range(90):
        if i % 3 == 0:
            rows.append((i, prose(9, 100), "en"))
        elif i % 3 == 1:
            words = list(base)
            words[rnd.randrange(120)] = f"edit{i}"
            rows.append((i, " ".join(words), "en"))
        else:
            rows.append((i, prose(100 + i, 90) + " one very common line that many texts share.", "en"))
    return frame(spark, rows)
