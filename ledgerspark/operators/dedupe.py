"""Numbering of equal rows and their content ids, outside the bounds of one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.text import content_id

SALTS = 64
EXPAND_ROWS = 1_000_000


def number_copies(rows: DataFrame, key: Sequence[str], *, salts: int = SALTS, expand_rows: int = EXPAND_ROWS) -> DataFrame:
    """Add `ordinal` (0-based within equal keys) and `id`.

    Wholly equal rows collapse to a count before anything travels.  The distinct
    rows of a key are spread over `salts` parts by content, numbered per part and
    shifted by the parts before; large counts are expanded in several tasks.  So
    no task holds all copies of one key.
    """
    rest = [c for c in rows.columns if c not in key]
    whole = [*key, *rest]
    counted = rows.groupBy(*whole).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)) if rest else F.lit(0))
    part = [*key, "_salt"]
    order = rest or [*key]
    local = F.sum("_n").over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    sizes = counted.groupBy(*part).agg(F.sum("_n").alias("_size"))
    before = F.sum("_size").over(W.partitionBy(*key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    shift = sizes.select(*part, F.coalesce(before, F.lit(0)).alias("_shift"))
    based = counted.withColumn("_local", F.coalesce(local, F.lit(0))).join(shift, part)
    based = based.select(*whole, "_n", (F.col("_local") + F.col("_shift")).alias("_base"))

    few = based.where(F.col("_n") <= expand_rows).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    many = based.where(F.col("_n") > expand_rows)
    many = many.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / expand_rows).cast("long"))))
    many = many.repartition(*whole, "_block")
    start = F.col("_block") * expand_rows
    many = many.withColumn("_i", F.explode(F.sequence(start, F.least(start + expand_rows, F.col("_n")) - 1))).drop("_block")
    out = few.unionByName(many).withColumn("ordinal", F.col("_base") + F.col("_i"))
    return out.withColumn("id", content_id(F.concat_ws("\u001f", *key), F.col("ordinal"))).drop("_n", "_base", "_i")
