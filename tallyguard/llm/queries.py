"""The registered queries of this subpackage and the comparison SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.decontamination import contaminations
from tallyguard.llm.exact_dedup import exact_duplicates
from tallyguard.llm.hard_negatives import hard_negatives
from tallyguard.llm.html_text import extract_text
from tallyguard.llm.jaccard_join import similar_documents
from tallyguard.llm.language_id import identify_languages
from tallyguard.llm.lexical_search import ranked_search
from tallyguard.llm.license_scan import license_scan
from tallyguard.llm.license_templates import TEMPLATES
from tallyguard.llm.packing import pack_documents
from tallyguard.llm.sharding import shard_documents
from tallyguard.llm.substring_dedup import near_duplicate_passages
from tallyguard.llm.suffix_dedup import repeated_bytes
from tallyguard.llm.token_counts import token_counts
from tallyguard.operators.materialise import shared_folder
from tallyguard.sources.tables import read_table

SHARDS = 24
TOKEN_LIMIT = 4096


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(read_table(spark, sf_dir, "documents"), model, TOKEN_LIMIT)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return contaminations(documents, read_table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(read_table(spark, sf_dir, "pages"), name="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = f"{shared_folder(spark)}/slot-maps/{uuid.uuid4()}"
    return shard_documents(read_table(spark, sf_dir, "documents"), SHARDS, maps)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"]
    )
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
        "spans",
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(read_table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents")).drop("spans")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_html_extraction": op7_html_extraction,
    "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

_TEMPLATE_ROWS = ", ".join(
    f"({n}, '{t.label}', {str(t.phrase).lower()}, '{t.text}')" for n, t in enumerate(TEMPLATES)
)
_LICENSE_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words"""

LLM_ORACLES: dict[str, str] = {
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        shingle AS (
            SELECT DISTINCT doc_id, unnest(list_transform(
                range(1, greatest(len(words) - 3, 1) + 1),
                lambda i: array_to_string(words[i:i + 3], ' '))) AS s
            FROM w WHERE len(words) > 0),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (
            SELECT a, b FROM common c JOIN size x ON x.doc_id = c.a JOIN size y ON y.doc_id = c.b
            WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT d.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(reach.b) AS component_id
        FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
        GROUP BY d.doc_id""",
    "op5_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept,
               sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op11_license_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_LICENSE_WORDS} FROM documents),
        t AS (
            SELECT *, CASE WHEN phrase THEN 2 ELSE 4 END AS size, {_LICENSE_WORDS}
            FROM (VALUES {_TEMPLATE_ROWS}) AS v(template, label, phrase, text)),
        known AS (
            SELECT template, label, phrase, size, len(words) AS total, tpos,
                   array_to_string(words[tpos:tpos + size - 1], ' ') AS run
            FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS tpos FROM t)),
        runs AS (
            SELECT id, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS run
            FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS pos
                  FROM d, (VALUES (2), (4)) AS v(size) WHERE len(words) >= size)),
        vote AS (
            SELECT r.id, k.*, r.pos, r.pos - k.tpos AS diagonal,
                   lag(r.pos) OVER (PARTITION BY r.id, k.template, r.pos - k.tpos ORDER BY r.pos) AS prev
            FROM runs r JOIN known k ON r.size = k.size AND r.run = k.run),
        diagonals AS (
            SELECT id, template, label, phrase, total, diagonal, min(pos) AS first, max(pos) + size AS ending,
                   sum(least(size, coalesce(pos - prev, size))) AS covered
            FROM vote GROUP BY id, template, label, phrase, total, size, diagonal),
        marked AS (
            SELECT *, max(ending) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached,
                   lag(diagonal) OVER b AS earlier
            FROM diagonals WINDOW b AS (PARTITION BY id, template ORDER BY first, diagonal)),
        near AS (
            SELECT *, coalesce(NOT phrase AND first - reached <= 12 AND abs(diagonal - earlier) <= 8, false) AS near
            FROM marked),
        numbered AS (
            SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY id, template ORDER BY first, diagonal) AS span,
                   greatest(0, covered - CASE WHEN near THEN greatest(0, reached - first) ELSE 0 END) AS gain
            FROM near),
        spans AS (
            SELECT id, label, phrase, min(first) - 1 AS first,
                   least(1.0, CAST(sum(gain) AS DOUBLE) / greatest(max(ending) - min(first), least(total, 16))) AS score
            FROM numbered GROUP BY id, template, label, phrase, total, span),
        good AS (SELECT * FROM spans WHERE score >= CASE WHEN phrase THEN 1.0 ELSE 0.8 END)
        SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(words)) AS BIGINT) AS n_words,
               count(*) FILTER (phrase) AS n_base,
               CAST(min(first) FILTER (phrase) AS BIGINT) AS first_word,
               CAST(max(first) FILTER (phrase) AS BIGINT) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
               CAST(coalesce(max(score), 0) AS DOUBLE) AS score
        FROM d LEFT JOIN good USING (id) GROUP BY id""",
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        b AS (
            SELECT item_id, unnest(list_distinct(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
            FROM benchmark),
        total AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
            FROM df, total),
        m AS (SELECT doc_id, 10 + (90 * len(terms) * docs) // words AS m FROM d, total WHERE len(terms) > 0),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM b JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank,
               doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS whole
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
                   CAST(list_inner_product(a.whole, c.whole) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
        p AS (
            SELECT * FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INT) AS rank,
               n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
          AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY rank <= 3""",
}
