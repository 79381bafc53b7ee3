"""The corpus pipeline: stages that each apply one operator to all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
their input. Null and empty texts, null ids, repeated rows and further columns are allowed; an empty
table passes as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.decontamination import with_matches
from tallyguard.llm.exact_dedup import exact_duplicates, lower_ascii
from tallyguard.llm.jaccard_join import similar_documents
from tallyguard.llm.language_id import UNDETERMINED, has_letter, labelled_samples, with_language
from tallyguard.llm.packing import pack_documents
from tallyguard.operators.materialise import shared_folder
from tallyguard.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A list of ids as a table in the shared folder: its size is known when the next join is planned."""
    path = f"{shared_folder(df.sparkSession)}/pipeline/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language cannot be told: null ones and those without a letter.

    The model learns from the labels of the given rows. A missing label is filled in; where no row with
    a letter has one, all of them stay without.
    """
    samples = labelled_samples(docs)
    if not samples:
        return docs.filter(has_letter(F.col("text")))
    found = with_language(docs, samples)
    kept = found.filter(F.col("lang_pred") != UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def keep_one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z in upper or lower case, the largest id stays.

    Of rows that repeat both the id and the text, one stays.
    """
    rows = exact_duplicates(docs).withColumnsRenamed({"doc_id": "_id", "text_sha256": "_sha"})
    dropped = _stored(rows.filter("NOT kept").select("_id", "_sha", "keep_id").distinct(), "copies")
    hashed = docs.withColumn("_hash", F.sha2(lower_ascii(F.col("text")).cast("binary"), 256))
    same = hashed["doc_id"].eqNullSafe(dropped["_id"]) & (hashed["_hash"] == dropped["_sha"])
    # as many rows may be dropped as there are, so both sides are shuffled, at every size alike
    unique = hashed.join(dropped.hint("merge"), same, "left_anti").select(docs.columns)
    # here the id that stays is among those that went: the row itself is repeated
    repeated = dropped.filter(F.col("_id").eqNullSafe(F.col("keep_id")))
    if repeated.isEmpty():
        return unique
    again = hashed["doc_id"].eqNullSafe(repeated["_id"]) & (hashed["_hash"] == repeated["_sha"])
    one_each = hashed.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "_hash"])
    return unique.union(one_each.select(docs.columns))


def keep_one_of_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar texts (five words, 0.8) connect, the smallest id stays.

    A row is judged by its id and its text, so of rows that repeat an id those with other texts stay; a
    null id is the smallest. Null texts and texts without words are similar to nothing and stay.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    similar = similar_documents(keyed, "_key", shingle_words=5, threshold=80)
    owners = keyed.select("_key", F.col("doc_id").alias("_id"))
    linked = _stored(similar.join(owners, "_key").select("component_id", "_id", "_key").distinct(), "linked")
    firsts = linked.groupBy("component_id").agg(
        F.min(F.struct("_id", "_key")).alias("first"), F.count("*").alias("rows")
    )
    several = _stored(firsts.filter("rows > 1").select("component_id", "first._key").toDF("component_id", "stays"), "firsts")
    others = linked.join(several, "component_id").filter(F.col("_key") != F.col("stays")).select("_key")
    dropped = _stored(others.distinct(), "similar")
    return keyed.join(dropped, "_key", "left_anti").select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, each row by its own text.

    Null and empty texts hold none and stay, whatever the id; so does everything when the benchmark is
    empty or has only null texts.
    """
    found = with_matches(docs, read_table(spark, sf_dir, "benchmark"), name="_matches")
    return found.filter(F.size("_matches") == 0).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token pieces in sequences; the columns are those of the packing operator.

    Null texts are packed as empty ones, and rows that repeat an id are packed each.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language id", keep_known_languages),
    ("exact dedup", keep_one_of_equal_texts),
    ("n-gram Jaccard join", keep_one_of_similar_texts),
    ("benchmark decontamination", drop_benchmark_passages),
    ("best-fit packing", pack_sequences),
]

# A trained classifier, edit distances and token ids cannot be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``; each result is stored and read back by the next."""
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
