"""Mixing sources to target weights by capped water-filling.

Targets share a number of words among the sources in proportion to their weights, but none
may exceed `epochs` times its source's own words.  Clamping and handing the excess on by
weight ends at a water level: sorted by cap per weight, the sources below the level take
their cap, the others level times weight.  Prefix sums over that order give the level
directly, so no loop runs.

Sampling is seeded by a hash of the document id.  A source whose target is 2.3 times its
size takes every document twice and, going through its documents in hash order, once more
those up to the point where 0.3 of its words are reached (the document across that point is
taken if at least half of it fits).  The point is found in two steps: word sums per hash
bucket (about the square root of a source's documents in number), then the documents of the
one bucket it lies in.  No source is sorted as a whole, and the decision for a document
needs only the row of its source.

Defined cases: a null or empty text has size 0; a null source is a source of its own, last;
a null id hashes like an empty string; rows alike in id and size share one verdict; a
source without words takes nothing; an empty table gives an empty result.  The table of
sources has one row per source and is sorted in one task, as the recipe it is.  Columns of
`df` other than id, source and text pass through `mixed` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import WORD, stage, text_of

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Source tables up to this many rows are broadcast (a few MB); larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000


def n_words(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def seeded(doc_id: Column, seed: str) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")))


def fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """`sources` (`_source`, `_total` and more) with `_target`: the water-filled share of all words."""
    turn = (F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    everything = W.partitionBy()
    ranked = sources.withColumn("_weight", weight).withColumns(
        {"_cap": F.col("_total") * float(epochs), "_all": F.sum("_total").over(everything).cast("double"), "_wall": F.sum("_weight").over(everything)}
    )
    below = W.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    capped, used = (F.coalesce(F.sum(c).over(below), F.lit(0.0)) for c in ("_cap", "_weight"))
    level = ranked.withColumn("_level", (F.col("_all") - capped) / (F.col("_wall") - used))
    # levels rise until the first source that stays below its cap and fall after it
    reached = F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))).over(everything)
    filled = level.withColumn("_reached", reached)
    target = F.coalesce(F.least(F.col("_cap"), F.col("_reached") * F.col("_weight")), F.col("_cap"))
    return filled.withColumn("_target", target).drop("_weight", "_cap", "_all", "_wall", "_level", "_reached")


def _bucket(key: Column, buckets: Column) -> Column:
    """Position of a hash among `buckets` equal intervals, in hash order."""
    return F.shiftright(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long") * buckets, 32)


def _place() -> Column:
    return F.struct("_key", F.col("_id").alias("_id"), "_size")


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """One row per source of `rows` (`_id`, `_source`, `_size`, `_key`): whole repetitions and where the last ends."""
    counted = rows.groupBy("_source").agg(F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("_n"))
    whole = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0).cast("int")
    sources = fill(counted, weights, epochs).withColumn("_whole", whole)
    sources = sources.withColumns(
        {"_extra": F.greatest(F.lit(0.0), F.col("_target") - F.col("_whole") * F.col("_total")), "_buckets": F.ceil(F.sqrt("_n")).cast("long")}
    )
    sources = stage(sources.withColumnRenamed("_source", "_of").drop("_n"), "mix-sources")
    placed = join_sources(rows, sources).withColumn("_bucket", _bucket(F.col("_key"), F.col("_buckets")))
    sums = placed.groupBy("_of", "_bucket").agg(F.sum("_size").alias("_sum"), F.first("_extra").alias("_extra"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_of").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    across = sums.withColumn("_before", before).where("_sum > 0 and _before <= _extra and _extra < _before + _sum")
    across = stage(across.select(F.col("_of").alias("_at"), F.col("_bucket").alias("_edge"), "_before"), "mix-edges")
    same = F.col("_of").eqNullSafe(F.col("_at"))
    inside = placed.join(_small(across), same & (F.col("_bucket") == F.col("_edge")))
    upto = F.sum("_size").over(W.partitionBy("_of").orderBy("_key", F.col("_id").asc_nulls_first(), "_size").rowsBetween(W.unboundedPreceding, 0))
    fits = inside.withColumn("_upto", upto).where(2 * (F.col("_before") + F.col("_upto")) - F.col("_size") <= 2 * F.col("_extra"))
    cuts = fits.groupBy(F.col("_of").alias("_in")).agg(F.max(_place()).alias("_cut"))
    out = sources.join(across.drop("_before"), same, "left").join(cuts, F.col("_of").eqNullSafe(F.col("_in")), "left")
    return stage(out.drop("_at", "_in"), "mix-plan")


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(_small(sources), F.col("_source").eqNullSafe(F.col("_of")))


def _times() -> Column:
    """Repetitions of a row that carries its source's plan."""
    at = _bucket(F.col("_key"), F.col("_buckets"))
    more = F.when(F.col("_edge").isNull(), False).otherwise((at < F.col("_edge")) | ((at == F.col("_edge")) & F.coalesce(_place() <= F.col("_cut"), F.lit(False))))
    return F.col("_whole") + F.when(more & (F.col("_size") > 0), 1).otherwise(0)


def _keyed(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: str, *more: Column) -> DataFrame:
    return df.select(
        *more, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(text_col).alias("_size"), seeded(F.col(id_col), seed).alias("_key")
    )


def mix_report(df: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, epochs=EPOCHS, seed=SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, times."""
    rows = stage(_keyed(df, id_col, source_col, text_col, seed), "sizes")
    out = join_sources(rows, plan(rows, weights, epochs)).withColumn("_times", _times())
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_times")).alias("taken"), F.col("_times").alias("times"),
    )


def mixed(df: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, epochs=EPOCHS, seed=SEED) -> DataFrame:
    """The mix itself: rows of `df`, each as often as it is taken."""
    rows = stage(_keyed(df, id_col, source_col, text_col, seed), "sizes")
    full = _keyed(df, id_col, source_col, text_col, seed, F.struct("*").alias("_row"))
    out = join_sources(full, plan(rows, weights, epochs)).withColumn("_times", _times()).where("_times > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source ASC NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([{', '.join(f'{x}.0' for x in WEIGHTS)}], CAST((i - 1) % {len(WEIGHTS)} + 1 AS INT)) AS DOUBLE) AS w,
             CAST(total AS DOUBLE) * {EPOCHS} AS cap FROM s),
l AS (SELECT *, (CAST(sum(total) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
      FROM w WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, total, coalesce(least(cap, w * (SELECT max(lvl) FROM l WHERE lvl * w <= cap)), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT d.doc_id, d.size, p.total, p.target, p.whole, greatest(0.0, p.target - p.whole * p.total) AS extra,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, total AS source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND 2 * upto - size <= 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN size > 0 AND 2 * upto - size <= 2 * extra THEN 1 ELSE 0 END AS INT) AS times
FROM q"""
