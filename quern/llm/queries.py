"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm import decontamination, language_id, lm_scoring, packing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity, warc


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = C.table(spark, sf_dir, "documents", "doc_id", "text"), C.table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_rules.score(documents, quality_rules.fit(documents, labels))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = C.table(spark, sf_dir, "documents", "doc_id", "text"), C.table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = C.crc_mod(5) == 0
    return toxicity.score(documents, toxicity.fit(documents, labels, keep=~held_out), held_out)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = C.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = C.crc_mod(3) == 1
    return language_id.predict(documents, language_id.fit(documents, keep=~held_out), held_out)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(C.table(spark, sf_dir, "documents", "doc_id", "text"), C.crc_mod(7) == 2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = C.table(spark, sf_dir, "documents", "doc_id", "text"), C.table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontamination.match(documents, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.score(C.table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.shared_folder(spark)
    warc.store(C.table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.facts(spark, path)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.score(C.table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = C.table(spark, sf_dir, "documents", "doc_id", "text"), C.table(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = C.crc_mod(3) == 1
    return quality_classifier.score(documents, quality_classifier.fit(documents, labels, keep=~held_out), held_out)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(C.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_language_id, op4_lm_scoring, op5_decontamination, op6_suffix_dedup, op7_warc, op8_simhash, op9_quality_classifier, op10_packing)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op5_decontamination": rf"""
        WITH words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
          SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
        places AS (
          SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, k)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
        names AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html, max(page_id) AS owner FROM p GROUP BY html)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN strlen(html) >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(html) >= 1000 AND page_id <> owner THEN owner END AS refers_to
        FROM p JOIN g USING (html)""",
}
