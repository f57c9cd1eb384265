"""Queries over the provided tables, one per operator, and SQL counterparts where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import exact, language, mixing, near, pieces, quality_rules, ranker, repair, spelling, sql, templates, turns, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    with open(model or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return pieces.coded_report(_table(spark, sf_dir, "documents"), f.read())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.template_report(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_report(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op10_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return repair.shard_report(_table(spark, sf_dir, "documents"), f.read())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_report(_table(spark, sf_dir, "conversations"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search_report(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_sentencepiece, op3_quality_rules, op4_line_templates, op5_quality_classifier, op6_mixing, op7_warc, op8_minhash_near_dedup,
        op9_language_id, op10_token_shards, op11_conversation_repair, op12_nearest_neighbours, op13_spelling_variants,
    )
}

ORACLES = {
    "op1_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_mixing": mixing.ORACLE,
    "op11_conversation_repair": sql.TURNS,
    "op13_spelling_variants": sql.SPELLING,
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM m""",
}
