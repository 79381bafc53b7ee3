"""Language identification by cross-parsing against labelled text.

For each language, the suffix automaton of a sample of labelled text gives, from any place of a new
text, the longest string that also occurs in the sample. A text is parsed greedily into such longest
phrases; phrases times the logarithm of the sample's length, over the length of the text, estimates the
cross entropy, and the language with the fewest normalised phrases wins.

The arcs of all automata stand in one array, state by state; each state has a bitmap of the byte classes
that it has arcs for, and the rank of a class in it finds the arc. So memory follows the number of states,
and many texts are parsed at once, one byte of each per step. Texts are parsed whole, in stretches of a
fixed length whose phrases are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.llm import texts as tx
from tallyguard.llm.models import tidy

UNDETERMINED = "und"
ROWS_PER_LANGUAGE = 64
CHARS_PER_ROW = 400
MAX_LANGUAGES = 256
STRETCH = 512
BYTES_AT_ONCE = 1 << 20


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def labelled_samples(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = ROWS_PER_LANGUAGE,
    chars: int = CHARS_PER_ROW,
) -> dict[str, str]:
    """A sample of text per language, from at most ``rows`` labelled rows and ``chars`` of each.

    Texts are dealt into ``rows`` buckets by their hash, and each bucket gives the text with the
    smallest one, of which a stretch is taken at a place that the hash chooses. So the choice depends
    on the texts alone, and copies count once. The driver holds languages x rows x chars characters; more than MAX_LANGUAGES labels are an error.
    """
    hashed = F.xxhash64(text_col)
    # the hashes of a bucket agree in their low part, so the place is taken from the high one
    places = F.greatest(F.length(text_col) - chars + 1, F.lit(1))
    start = (F.pmod(F.shiftrightunsigned(hashed, 20), places) + 1).cast("int")
    usable = docs.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(
        F.col(lang_col).alias("lang"), hashed.alias("h"), F.substr(text_col, start, F.lit(chars)).alias("t")
    )
    chosen = usable.groupBy("lang", F.pmod("h", F.lit(rows)).alias("bucket")).agg(F.min("h").alias("h"))
    chosen = chosen.limit(MAX_LANGUAGES * rows + 1).collect()
    if len({r["lang"] for r in chosen}) > MAX_LANGUAGES or len(chosen) > MAX_LANGUAGES * rows:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not chosen:
        return {}
    wanted = docs.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in chosen], "lang string, h long")
    texts = usable.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t"))
    samples: dict[str, list[str]] = {}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(row["lang"], []).append(row["t"])
    return {lang: "\n".join(parts).lower() for lang, parts in samples.items()}


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """The transitions of the smallest automaton of all suffixes; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for symbol in symbols:
        state = len(following)
        following.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in following[p]:
            following[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = following[p][symbol]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(symbol) == q:
                    following[p][symbol] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return following


class CrossParser:
    """Parses texts against the samples of all languages at once."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        contents = [samples[lang].encode("utf-8", "replace") for lang in self.languages]
        known = sorted(set(b"".join(contents)))
        # class 0 is for bytes that no sample has, and for the padding
        self.classes = np.zeros(256, np.uint8)
        self.classes[known] = np.arange(1, len(known) + 1)
        self.words = (len(known) + 1 + 63) // 64
        counts, states, symbols, targets = [np.zeros(1, np.int64)], [], [], []
        self.starts = []
        for content in contents:
            automaton = suffix_automaton(content)
            base = sum(len(c) for c in counts) - 1
            self.starts.append(base)
            sizes = np.array([len(arcs) for arcs in automaton], np.int64)
            counts.append(sizes)
            states.append(np.repeat(np.arange(base, base + len(sizes), dtype=np.int32), sizes))
            arcs = [pair for of_state in automaton for pair in sorted(of_state.items())]
            symbol, target = np.array(arcs, np.int64).reshape(-1, 2).T
            symbols.append(self.classes[symbol])
            targets.append((target + base).astype(np.int32))
        nothing = np.zeros(0, np.int32)
        state, symbol = np.concatenate([nothing, *states]), np.concatenate([nothing.astype(np.uint8), *symbols])
        # the arcs by state and class, and one more entry that is looked at but never taken
        self.arcs = np.concatenate([*targets, np.zeros(1, np.int32)])
        total = sum(len(c) for c in counts) - 1
        cell = state.astype(np.int64) * self.words + (symbol >> 6)
        self.masks = np.zeros(total * self.words, np.uint64)
        np.bitwise_or.at(self.masks, cell, np.uint64(1) << (symbol.astype(np.uint64) & np.uint64(63)))
        self.offsets = np.searchsorted(cell, np.arange(total * self.words)).astype(np.int32)
        # where a phrase begins that starts with a class
        self.again = np.repeat(np.array(self.starts, np.int32)[:, None], 256, axis=1)
        for i, base in enumerate(self.starts):
            first = state == base
            self.again[i, symbol[first]] = self.arcs[:-1][first]
        self.weights = np.array([math.log2(len(c) + 2) for c in contents])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """The number of phrases of every (text, language)."""
        lengths = np.array([len(t) for t in texts], np.int64)
        lanes = -(-lengths // STRETCH)
        first = np.concatenate([[0], np.cumsum(lanes)])
        codes = np.zeros(int(first[-1]) * STRETCH, np.uint8)
        for at, text in zip(first, texts):
            codes[at * STRETCH : at * STRETCH + len(text)] = self.classes[np.frombuffer(text, np.uint8)]
        steps = np.ascontiguousarray(codes.reshape(-1, STRETCH).T)
        state = np.repeat(np.array(self.starts, np.int32)[:, None], steps.shape[1], axis=1)
        goes_on = np.zeros_like(state)
        one = np.uint64(1)
        for step in steps:
            bit = one << (step.astype(np.uint64) & np.uint64(63))
            cell = state if self.words == 1 else state * np.int32(self.words) + (step >> 6)
            mask = self.masks.take(cell)
            has = (mask & bit) != 0
            place = self.offsets.take(cell) + np.bitwise_count(mask & (bit - one))
            state = np.where(has, self.arcs.take(place), self.again.take(step, axis=1))
            goes_on += has
        of_lane = np.repeat(np.arange(len(texts)), lanes)
        ends = STRETCH - goes_on
        totals = np.stack([np.bincount(of_lane, e, len(texts)) for e in ends], axis=1)
        # each padding byte ended a phrase, and the last phrase of a stretch has not been counted
        padding = lanes * STRETCH - lengths
        return totals - padding[:, None] + lanes[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The best language of each text, and how far it is ahead of the second (0 to 1).

        Of languages that are equally good the first one by name is given, with score 0.
        """
        contents = [t.lower().encode("utf-8", "replace") for t in texts]
        names, scores = [], []
        at = 0
        while at < len(contents):
            end, size = at, 0
            while end < len(contents) and (end == at or size + len(contents[end]) <= BYTES_AT_ONCE):
                size += len(contents[end])
                end += 1
            costs = self.phrases(contents[at:end]) * self.weights
            best = costs.argmin(axis=1)
            low = costs[np.arange(end - at), best]
            if len(self.languages) > 1:
                ahead = 1 - low / np.maximum(np.partition(costs, 1, axis=1)[:, 1], 1e-9)
            else:
                ahead = np.ones(end - at)
            names += [self.languages[i] for i in best]
            scores += np.clip(ahead, 0, 1).tolist()
            at = end
        return names, scores


def with_language(
    docs: DataFrame, samples: dict[str, str], text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``; only the text decides.

    A text that is null or has no letter is ``und`` with score 0, and so is every text when there
    are no samples. Rows of the input keep their number, and repeated rows get the same answer; texts
    of any length are parsed whole. Columns of ``docs`` that have the new names are replaced. The
    automata, some 3 MB a language, are built once and broadcast.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    text = F.col(text_col)
    # a text that stays in the rows travels once
    at = kept.index(text_col) if text_col in kept else len(kept)
    extra = [] if text_col in kept else [text.alias("_parsed")]
    rows = docs.select(*kept, *extra, has_letter(text).alias("_has_letter"))
    schema = T.StructType(
        [
            *rows.schema.fields[: len(kept)],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    parser = docs.sparkSession.sparkContext.broadcast(CrossParser(samples)) if samples else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.parts(batches, at, BYTES_AT_ONCE):
            letters = batch.columns[-1]
            usable = letters.to_numpy(zero_copy_only=False)
            names, scores = np.full(len(usable), UNDETERMINED, object), np.zeros(len(usable))
            if parser is not None and usable.any():
                texts = batch.column(at).filter(letters).to_pylist()
                names[usable], scores[usable] = parser.value.predict(texts)
            found = [pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *found], names=[*kept, "lang_pred", "score"]
            )

    return rows.mapInArrow(tidy(predict), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the rows not held out.

    Rows with a null id are never learned from and count as not held out.
    """
    training = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    samples = labelled_samples(training, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return with_language(rows, samples, "_text").drop("_text")
