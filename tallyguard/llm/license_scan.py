"""Licence scans by diagonal voting.

Rolling hashes of runs of words are joined to the places of the same runs in the templates. A shared run
votes for a diagonal, its place in the text minus its place in the template. The votes of a text are
summed per template and diagonal, neighbouring diagonals are merged into spans, and a span counts when
enough of its words were shared word by word.

A worker lets only runs out whose hash some template has; the join compares the words themselves. The
templates are a parameter and small, so they are broadcast. Votes combine before the shuffle, texts are
not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.llm import texts as tx
from tallyguard.llm.license_templates import TEMPLATES, Template
from tallyguard.llm.models import tidy

PHRASE_RUN = 2
NOTICE_RUN = 4
# A span merges diagonals at most so far apart, over gaps of so many words.
SHIFT = 8
GAP = 12
# The words that a span of a long template must have, and the share of a span that must be shared.
ENOUGH = 16
SHARED = 0.8
_RUNS = "array<struct<pos:int,hash:bigint,run:string,before:string>>"
_SCANNED = f"row long, id long, n_words long, runs {_RUNS}"


def _run_hashes(values: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words of one text; the size is part of the hash."""
    count = max(0, len(values) - size + 1)
    first = np.flatnonzero(text[:count] == text[size - 1 : size - 1 + count])
    total = np.full(len(first), size, np.uint64)
    for k in range(size):
        total = tx.mix(total + values[first + k], 3 + k)
    return first, total


def words_of(text: str) -> list[str]:
    content, starts = tx.utf8(pa.array([text]))
    content = tx.LOWER[content]
    first, end, _ = tx.words(content, starts, tx.NOT_IN_TERMS)
    return [content[a:b].tobytes().decode() for a, b in zip(first, end)]


def run_size(template: Template) -> int:
    return PHRASE_RUN if template.phrase else NOTICE_RUN


def template_places(templates: Sequence[Template]) -> list[tuple]:
    """(hash, run, before, template, tpos) of every run of every template."""
    rows = []
    for number, template in enumerate(templates):
        words, size = words_of(template.text), run_size(template)
        content, starts = tx.utf8(pa.array([" ".join(words)]))
        first, end, text = tx.words(content, starts, tx.NOT_IN_TERMS)
        at, hashes = _run_hashes(tx.SpanHashes(content)(first, end), text, size)
        for place, value in zip(at.tolist(), hashes.view(np.int64).tolist()):
            before = words[place - 1] if place else None
            rows.append((value, " ".join(words[place : place + size]), before, number, place))
    return rows


def _scan(batches: Iterator[pa.RecordBatch], known: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(id, t) -> a row per text with the runs that some template may have."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in tx.parts(batches, 1):
        count = batch.num_rows
        content, starts = tx.utf8(batch.column(1))
        content = tx.LOWER[content]
        first, end, text = tx.words(content, starts, tx.NOT_IN_TERMS)
        lengths = np.bincount(text, minlength=count)
        begins = np.cumsum(lengths) - lengths
        values = tx.SpanHashes(content)(first, end)
        runs: list[list[dict]] = [[] for _ in range(count)]
        for size in sizes:
            at, hashes = _run_hashes(values, text, size)
            slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[slot] == hashes
            for word, value in zip(at[hit].tolist(), hashes[hit].view(np.int64).tolist()):
                owner = int(text[word])
                spoken = [content[first[i] : end[i]].tobytes().decode() for i in range(max(word - 1, 0), word + size)]
                place = int(word - begins[owner])
                runs[owner].append(
                    {
                        "pos": place,
                        "hash": value,
                        "run": " ".join(spoken[-size:]),
                        "before": spoken[0] if place else None,
                    }
                )
        kind = pa.list_(
            pa.struct([("pos", pa.int32()), ("hash", pa.int64()), ("run", pa.string()), ("before", pa.string())])
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + count)),
                batch.column(0),
                pa.array(lengths, pa.int64()),
                pa.array(runs, kind),
            ],
            names=["row", "id", "n_words", "runs"],
        )
        row += count


def _diagonals(spark: SparkSession, scanned: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """One row per text, template and diagonal: shared runs, first word and past-the-last word, and the
    words covered. A text without a shared run keeps a row without a template."""
    places = spark.createDataFrame(
        template_places(templates), "hash long, run string, before string, template int, tpos int"
    )
    dims = spark.createDataFrame(
        [
            (n, t.label, t.phrase, len(words_of(t.text)), run_size(t))
            for n, t in enumerate(templates)
        ],
        "template int, label string, phrase boolean, template_words int, size int",
    )
    runs = scanned.select("row", "id", "n_words", F.explode_outer("runs").alias("g")).select(
        "row", "id", "n_words", "g.*"
    )
    # as large as the templates, whatever the texts are
    looked_up = F.broadcast(
        places.join(F.broadcast(dims), "template").withColumnsRenamed({"before": "t_before", "run": "t_run"})
    )
    votes = runs.join(
        looked_up, (runs["hash"] == looked_up["hash"]) & (runs["run"] == looked_up["t_run"]), "left"
    )
    # a run whose predecessor is shared as well adds one word, any other all of its words
    opens = F.col("template").isNotNull() & ~F.coalesce(F.col("before") == F.col("t_before"), F.lit(False))
    grouped = votes.groupBy(
        "row", "id", "n_words", "template", "label", "phrase", "template_words", "size",
        (F.col("pos") - F.col("tpos")).alias("diagonal"),
    ).agg(
        F.count("template").alias("shared"),
        F.sum(opens.cast("int")).alias("opened"),
        F.min("pos").alias("first"),
        (F.max("pos") + F.first("size")).alias("end"),
    )
    covered = F.col("shared") + (F.col("size") - 1) * F.col("opened")
    return grouped.withColumn("covered", covered)


def _spans(diagonals: DataFrame) -> DataFrame:
    """Neighbouring diagonals of a notice as one span, with the share of its words that are covered.

    Words that two diagonals may both cover count once. Every diagonal of a phrase is a span of its own.
    """
    in_order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end").over(before)
    shift = F.abs(F.col("diagonal") - F.lag("diagonal").over(in_order))
    near = ~F.col("phrase") & (F.col("first") - reached <= GAP) & (shift <= SHIFT)
    marked = diagonals.withColumns({"reached": reached, "near": F.coalesce(near, F.lit(False))})
    overlap = F.when(F.col("near"), F.greatest(F.lit(0), F.col("reached") - F.col("first"))).otherwise(0)
    numbered = marked.withColumns(
        {
            "span": F.sum((~F.col("near")).cast("int")).over(in_order),
            "gain": F.greatest(F.lit(0), F.col("covered") - overlap),
        }
    )
    merged = numbered.groupBy(
        "row", "id", "n_words", "template", "label", "phrase", "template_words", "span"
    ).agg(
        F.min("first").alias("first"),
        F.max("end").alias("end"),
        F.sum("gain").alias("covered"),
    )
    wanted = F.greatest(F.col("end") - F.col("first"), F.least("template_words", F.lit(ENOUGH)))
    return merged.withColumn("score", F.least(F.lit(1.0), F.col("covered") / wanted))


def _labels(condition: Column) -> Column:
    found = F.collect_set(F.when(condition, F.col("label")))
    return F.array_join(F.array_sort(found), ",")


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES,
) -> DataFrame:
    """One row per text: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places of all phrases; ``first_word`` and ``last_word`` are the smallest and the
    largest of them. ``labels`` has the labels of the phrases and those of verified spans, ``score`` is
    the largest share among them, 1 for a phrase and 0 without any. ``spans`` lists (label, start, end,
    score) in words. Null and empty texts have no words and no labels; every row is judged for itself, so
    ids may be null or repeat. Other columns are not read.
    """
    spark = docs.sparkSession
    if not templates:
        templates = [Template("", "", True)]
    known = np.unique(np.array([r[0] for r in template_places(templates)] or [0], np.int64).view(np.uint64))
    sizes = sorted({run_size(t) for t in templates})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(batches, known, sizes)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    diagonals = _diagonals(spark, texts.mapInArrow(tidy(scan), _SCANNED), templates)
    # all words of a phrase must be there; a text without a shared run has a span without a score
    enough = F.when(F.col("phrase"), F.lit(1.0)).otherwise(F.lit(SHARED))
    has_label = F.coalesce(F.col("score") >= enough, F.lit(False))
    is_base = has_label & F.col("phrase")
    start = F.when(is_base, F.col("first").cast("long"))
    span = F.struct("label", F.col("first").alias("start"), "end", "score")
    return (
        _spans(diagonals)
        .groupBy("row", "id", "n_words")
        .agg(
            F.count_if(is_base).alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            _labels(is_base).alias("base_labels"),
            _labels(has_label).alias("labels"),
            F.coalesce(F.max(F.when(has_label, F.col("score"))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(has_label, span))).alias("spans"),
        )
        .drop("row")
        .withColumnRenamed("id", id_col)
    )
