"""A corpus in five stages: language, exact copies, near copies, mixture, token round trip.

Each stage reads all that the one before kept.  `run` writes every stage's result below
spark.checkpoint.dir and reads it again for the next, so a lost executor costs a stage at most.
Null and empty texts have no language and go in the first stage; repeated rows go in the
second; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import exact, language, mixing, near, pieces
from ledgerspark.llm.common import stage

#: The tokenizer's model file; read on the driver and sent to the tasks.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return language.in_known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.without_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents come as often as the mix takes them."""
    return mixing.mixed(docs)


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the text decoded from them, and whether it is the same."""
    with open(MODEL, "rb") as f:
        return pieces.coded(docs, f.read())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("sentencepiece", coding_stage),
]

#: Learned labels, hash minima and merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
