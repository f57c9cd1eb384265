"""Running aggregates per key that hold up when one key owns most of the rows.

A plain window puts a whole key into one task.  `Ordered` first counts the rows
per key; while every key is moderate it uses that plain window (one shuffle, no
extra join).  Keys above the limit are cut into consecutive chunks along the
sort order.  Each chunk is scanned on its own, the chunk totals (one row per
chunk) are scanned per key, and the carried-in value is joined back.  Every
supported aggregate is associative, so both ways give the same result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOT_ROWS = 20_000_000
CHUNK_ROWS = 2_000_000
TASK_ROWS = 250_000
SMALL_ROWS = 1_000_000
_OVERSAMPLE = 4
_CHUNK = "_chunk"
_FIRST = W.unboundedPreceding


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys owning more than `limit` rows; at most total/limit of them exist."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)


def has_hot_key(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    return not hot_keys(df, keys, limit).isEmpty()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of this machine only for a local session without one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="ledgerspark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the session's checkpoint folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the session's checkpoint folder and read it from there.

    For wide rows that many branches read, each a few columns or rows of it; `cut_lineage` reads back whole rows.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_hot(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of moderate keys, dealt by key, rows of hot keys or None when there are none)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total, n_hot = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count_if(F.col("_rows") > limit)).first()
    if not n_hot:
        return deal(df, keys, total), None
    hot = F.broadcast(cut_lineage(hot_keys(df, keys, limit).select(*keys)))  # bounded: at most total/limit keys
    return deal(df.join(hot, list(keys), "left_anti"), keys, total), df.join(hot, list(keys), "left_semi")


def deal(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """`df` by key in as many partitions as keep each small enough to be sorted in memory, however many rows there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def small_side(df: DataFrame) -> DataFrame:
    """`df` computed once, and broadcast where it is counted to be small: rows it is joined to stay in place."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _position(bounds: Column, key: Column) -> Column:
    """Number of sorted `bounds` that are <= key (binary search)."""
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        unfinished = s["lo"] < s["hi"]
        right = F.get(bounds, mid) <= key
        return F.struct(
            F.when(unfinished & right, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(unfinished & ~right, mid).otherwise(s["hi"]).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda s: s["lo"])


def _with_chunks(df: DataFrame, keys: list[str], order: list[str], limit: int, chunk: int) -> DataFrame:
    """Add `_chunk`: -1 for moderate keys, consecutive numbers for hot ones."""
    df = cut_lineage(df)
    hot = cut_lineage(hot_keys(df, keys, limit))
    spot = F.struct(*order)
    stride = max(1, chunk // _OVERSAMPLE)
    every = _OVERSAMPLE if stride > 1 else chunk
    points = (
        df.join(F.broadcast(hot.select(*keys)), keys, "left_semi")
        .where(F.pmod(F.xxhash64(*keys, *order), F.lit(stride)) == 0)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(spot)).alias("_all"))
    )
    bounds = points.select(
        *keys, F.filter("_all", lambda _, i: F.pmod(i + 1, F.lit(every)) == 0).alias("_bounds")
    )
    marked = hot.select(*keys).join(bounds, keys, "left")
    marked = marked.withColumn("_hot", F.lit(True))
    # bounded: at most total/limit keys and total/chunk boundaries
    out = df.join(F.broadcast(marked), keys, "left")
    at = F.when(F.col("_bounds").isNull(), 0).otherwise(_position(F.col("_bounds"), spot))
    return out.withColumn(_CHUNK, F.when(F.col("_hot"), at).otherwise(F.lit(-1))).drop("_bounds", "_hot")


class Ordered:
    """Rows of `df` per `keys`, sorted by `order` (unique within a key)."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        *,
        hot_rows: int | None = None,
        chunk_rows: int | None = None,
        chunked: bool | None = None,
    ):
        self.keys, self.order = list(keys), list(order)
        self.limit = HOT_ROWS if hot_rows is None else hot_rows
        self.chunk = CHUNK_ROWS if chunk_rows is None else chunk_rows
        self.chunked = has_hot_key(df, self.keys, self.limit) if chunked is None else chunked
        self.df = _with_chunks(df, self.keys, self.order, self.limit, self.chunk) if self.chunked else df

    def resort(self, df: DataFrame, order: Sequence[str]) -> "Ordered":
        """The same keys under another sort order."""
        return Ordered(
            df, self.keys, order, hot_rows=self.limit, chunk_rows=self.chunk, chunked=self.chunked
        )

    def refine(self, df: DataFrame, extra: Sequence[str]) -> "Ordered":
        """Longer keys, same order; only a hot key can have a hot refinement."""
        return Ordered(
            df,
            self.keys + list(extra),
            self.order,
            hot_rows=self.limit,
            chunk_rows=self.chunk,
            chunked=None if self.chunked else False,
        )

    def frame(self) -> DataFrame:
        return self.df.drop(_CHUNK) if self.chunked else self.df

    def _asc(self, by: list[str]):
        return W.partitionBy(*by).orderBy(*self.order)

    def _desc(self, by: list[str]):
        return W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in self.order])

    def _local(self, by: list[str], kind: str, x: Column) -> Column:
        upto = self._asc(by).rowsBetween(_FIRST, 0)
        if kind == "sum":
            return F.sum(x).over(upto)
        if kind == "min_before":
            return F.min(x).over(self._asc(by).rowsBetween(_FIRST, -1))
        if kind == "max":
            return F.max(x).over(upto)
        if kind == "first":
            return F.first(x, ignorenulls=True).over(upto)
        if kind == "carry":
            return F.last(x, ignorenulls=True).over(upto)
        if kind == "next":
            # running frame over the reversed order: linear, unlike a following frame
            return F.last(x, ignorenulls=True).over(self._desc(by).rowsBetween(_FIRST, 0))
        if kind == "lag":
            return F.lag(x).over(self._asc(by))
        raise ValueError(kind)

    def _total(self, kind: str, x: Column) -> Column:
        spot = F.struct(*self.order)
        if kind == "sum":
            return F.sum(x)
        if kind == "min_before":
            return F.min(x)
        if kind == "max":
            return F.max(x)
        if kind in ("carry", "lag"):
            return F.max_by(x, F.when(x.isNotNull(), spot))
        return F.min_by(x, F.when(x.isNotNull(), spot))

    def _carried(self, kind: str, name: str) -> Column:
        back = W.partitionBy(*self.keys).orderBy(_CHUNK).rowsBetween(_FIRST, -1)
        ahead = W.partitionBy(*self.keys).orderBy(F.col(_CHUNK).desc()).rowsBetween(_FIRST, -1)
        x = F.col(name)
        if kind == "sum":
            return F.sum(x).over(back)
        if kind == "min_before":
            return F.min(x).over(back)
        if kind == "max":
            return F.max(x).over(back)
        if kind == "first":
            return F.first(x, ignorenulls=True).over(back)
        if kind == "next":
            return F.last(x, ignorenulls=True).over(ahead)
        return F.last(x, ignorenulls=True).over(back)

    @staticmethod
    def _merge(kind: str, local: Column, before: Column) -> Column:
        if kind == "sum":
            return F.when(before.isNull(), local).otherwise(F.coalesce(local, local * 0, before * 0) + before)
        if kind == "min_before":
            return F.least(local, before)
        if kind == "max":
            return F.greatest(local, before)
        if kind == "first":
            return F.coalesce(before, local)
        return F.coalesce(local, before)

    def running(self, **specs: tuple[str, Column]) -> "Ordered":
        """Add one column per spec, `name=(kind, value)`.

        Kinds: sum, max, first and carry (first and last known value so far),
        next (first known value from here on), min_before and lag (both without the current row;
        `lag` expects values that are never NULL).
        """
        if not self.chunked:
            cols = {n: self._local(self.keys, k, x) for n, (k, x) in specs.items()}
            if any(k == "next" for k, _ in specs.values()):
                # the previous row is the following one of the reversed order: one sort for both
                cols |= {n: F.lead(x).over(self._desc(self.keys)) for n, (k, x) in specs.items() if k == "lag"}
            self.df = self.df.withColumns(cols)
            return self
        by = self.keys + [_CHUNK]
        inner = cut_lineage(self.df)  # read twice below
        totals = (
            inner.where(F.col(_CHUNK) >= 0)
            .groupBy(*by)
            .agg(*[self._total(k, x).alias(f"_t_{n}") for n, (k, x) in specs.items()])
        )
        carried = totals.select(*by, *[self._carried(k, f"_t_{n}").alias(f"_b_{n}") for n, (k, _) in specs.items()])
        inner = inner.withColumns({f"_l_{n}": self._local(by, k, x) for n, (k, x) in specs.items()})
        joined = inner.join(carried, by, "left")
        merged = {
            n: self._merge(k, F.col(f"_l_{n}"), F.col(f"_b_{n}")) for n, (k, _) in specs.items()
        }
        drop = [f"_{p}_{n}" for n in specs for p in "lb"]
        self.df = joined.withColumns(merged).drop(*drop)
        return self
