"""Orderings, top-k and the fold of the rest into one Other row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.numeric import exact_sum

OTHER = "__other"


def holdings_order(holdings: DataFrame) -> DataFrame:
    """Open positions first, by value (unknown last), then symbol."""
    return holdings.orderBy("portfolio_id", "closed", F.coalesce("market_value_base", F.lit(-1.0)).desc(), "symbol")


def user_order(rows: DataFrame, column: str, *, descending: bool = False, tie: str = "symbol") -> DataFrame:
    """Sort by any column; unknown values stay last in both directions."""
    c = F.col(column)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def top_k(df: DataFrame, scope: Sequence[str], value: str, key: str, k: int) -> DataFrame:
    """Largest `k` rows per scope, ties on the key; ranked before the shuffle too."""
    w = W.partitionBy(*scope).orderBy(F.col(value).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fold_other(
    df: DataFrame, scope: Sequence[str], bucket: Sequence[str], key: str, value: str, k: int, order: Sequence[str] | None = None
) -> DataFrame:
    """Keep the `k` largest keys of each scope, add all others up per bucket.

    Rows still sum to their bucket.  `order` puts named keys first; names that
    do not occur are ignored.
    """
    # one row per cell first: everything after works on cells, not on facts
    cells = df.groupBy(*scope, *bucket, key).agg(exact_sum(value).alias(value))
    total = cells.groupBy(*scope, key).agg(exact_sum(value).alias("_total"))
    if order:
        place = F.nullif(F.array_position(F.lit(list(order)), F.col(key)), F.lit(0))
    else:
        place = F.lit(None).cast("long")
    w = W.partitionBy(*scope).orderBy(place.asc_nulls_last(), F.col("_total").desc(), F.col(key))
    shown = total.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).select(*scope, key, "_rank")
    marked = cells.join(shown, [*scope, key], "left")
    name = F.when(F.col("_rank").isNotNull(), F.col(key)).otherwise(F.lit(OTHER))
    return (
        marked.withColumn(key, name).groupBy(*scope, *bucket, key)
        .agg(exact_sum(value).alias(value), F.coalesce(F.min("_rank"), F.lit(k + 1)).alias("rank"))
    )
