"""Exact deduplication by a heavy-hitter split.

A Misra-Gries summary names the digests that may be frequent; their exact counts and best
rows are verified and broadcast (a fixed number of rows), so the copies of a frequent text
are settled map-side.  All other digests take one ordinary shuffle.

Defined cases: a null text counts as empty, and all empty texts are one group.  Ties on the
id cannot change the result: repeated rows of the id that stays are all marked kept, and
`without_copies` returns exactly one of them.  A null id loses against any other.  An empty
table gives an empty result.  Only the id and text columns are read for the report; columns
of other names, clashing ones included, pass through `without_copies` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import best_of_group, forget, hot_groups, lower_ascii, stage, text_of


def digest(text: str) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    return F.unhex(F.sha2(lower_ascii(text_of(text)).cast("binary"), 256))


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stage(df.select(F.col(id_col).alias("_id"), digest(text_col).alias("_digest")), "digests")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    best = best_of_group(_digests(df, id_col, text_col), "_digest", "_id")
    return best.select(
        F.col("_id").alias("doc_id"), F.col("_best").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_best")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of `df`: of equal texts the one with the largest id.

    Copies of frequent texts are dropped before the shuffle; the text travels once.
    """
    slim = _digests(df, id_col, text_col)
    hot = hot_groups(slim, "_digest", "_id")
    forget(slim)
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), digest(text_col).alias("_digest"))
    left = rows.join(F.broadcast(hot), "_digest", "left").where(F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_best")))
    first = F.row_number().over(W.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last()))
    return left.withColumn("_n", first).where("_n = 1").select("_row.*")
