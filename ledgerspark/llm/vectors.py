"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each half is quantised by its own centroids, and an entry lives
in the cell of its pair.  A query orders the centroids of each half by inner product and walks
the pairs from the largest sum down with a heap, until the cells passed hold enough entries.
The entries of these cells are reranked by the exact inner product of the original vectors.

Centroids are fitted on at most SAMPLE entries of smallest hash; every entry is indexed.  How
much a query must pass is measured on the same sample: the share of its entries that finds
RECALL of the exact neighbours there, where as many neighbours are asked as fall into a sample
of that size.  Clustered vectors need a small share, vectors without structure a large one.

Equal vectors are one entry that keeps their smallest ids, and equal queries are searched once,
so a vector with a third of all rows costs what one row costs.  Neighbouring cells share a
block of about BLOCK entries (a larger cell has several blocks); a query travels to a block
once, with the cells it passes there, and meets the block as a product of matrices.  Only the
best few leave a task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id, nor vectors of another length than most have (ties: the
longer); rows that repeat an id are rows of their own; with fewer candidates than asked all
are returned; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.blocks import dealt, meetings
from ledgerspark.llm.common import stage

NEIGHBOURS, EVERY = 20, 20
SAMPLE, SAMPLE_QUERIES, RECALL = 16_384, 512, 0.97
#: Entries aimed at in a cell, the most centroids of a half, entries of a block.
CELL, MOST_CENTROIDS, BLOCK = 64, 256, 8192
ROUNDS, _ASKED_AT_ONCE, _BATCH = 10, 256, 2048
#: Rows of one query vector above which they are spread, at least and as a share.
HOT, HOT_SHARE = 10_000, 1000


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`_id`, `_v` (doubles), `_k1`, `_k2` (together the key of the vector) of rows that take part."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).where("_id is not null and size(_v) > 0")
    rows = rows.where(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("_v", lambda x: x != 0))
    common = rows.groupBy(F.size("_v").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max(F.struct("_n", "_d")).alias("_m")).first()["_m"]
    rows = rows.where(F.size("_v") == (common["_d"] if common else 0))
    # 0.0 and -0.0 are one number
    same = F.transform("_v", lambda x: F.when(x == 0, 0.0).otherwise(x))
    return rows.select("_id", "_v", F.xxhash64(same).alias("_k1"), F.xxhash64(F.lit(1), same).alias("_k2"))


def _halves(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = found.shape[1] // 2
    return found[:, :cut], found[:, cut:]


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def centroids(points: np.ndarray, k: int) -> np.ndarray:
    """k-means from k points spread over the sample."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(points, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def cells_of(found: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = (_nearest(half, book) for half, book in zip(_halves(found), books, strict=True))
    return a * len(books[1]) + b


def walk(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, enough: float) -> list[int]:
    """Cells by falling sum of inner products, until those passed hold `enough` entries; empty cells are left out."""
    a, b = (book @ half for half, book in zip(np.split(query, [len(query) // 2]), books, strict=True))
    by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b, width = a.tolist(), b.tolist(), len(by_b)
    heap, out, passed = [(-a[by_a[0]] - b[by_b[0]], 0, 0)], [], 0
    while heap and passed < enough:
        _, i, j = heapq.heappop(heap)
        cell = by_a[i] * width + by_b[j]
        if sizes[cell]:
            out.append(cell)
            passed += sizes[cell]
        if j == 0 and i + 1 < len(by_a):
            heapq.heappush(heap, (-a[by_a[i + 1]] - b[by_b[0]], i + 1, 0))
        if j + 1 < width:
            heapq.heappush(heap, (-a[by_a[i]] - b[by_b[j + 1]], i, j + 1))
    return out


def share_needed(found: np.ndarray, books: tuple[np.ndarray, np.ndarray], wanted: int) -> float:
    """The share of the sample that a query must pass to find RECALL of its `wanted` exact neighbours."""
    cells = cells_of(found, books)
    sizes = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    wanted, before = min(wanted, len(found) - 1), []
    if wanted < 1:
        return 1.0
    for i in np.linspace(0, len(found) - 1, min(len(found), SAMPLE_QUERIES)).astype(np.int64):
        scores = found @ found[i]
        scores[i] = -np.inf
        order = walk(found[i], books, sizes, np.inf)
        start = np.zeros(len(sizes))
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        before.append(start[cells[np.argpartition(-scores, wanted - 1)[:wanted]]])
    return min(1.0, (float(np.quantile(np.concatenate(before), RECALL)) + 1) / len(found))


def _numbers(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _in_cells(books: tuple[np.ndarray, np.ndarray], width: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_of(_numbers(batch.column("_v"), width), books))], [*batch.schema.names, "_cell"])

    return place


_DEALT = "_part long, _block long, _role int, _k1 long, _k2 long, _v array<double>, _ids array<long>, _cells array<long>"


class _Layout:
    """Which blocks hold which cells."""

    def __init__(self, sizes: np.ndarray):
        before = np.cumsum(sizes) - sizes
        self.first = before // BLOCK
        self.count = np.maximum(1, -(-sizes // BLOCK))
        # blocks of cells that need several come after all others
        large = np.flatnonzero(self.count > 1)
        starts = int(self.first.max(initial=0)) + 1 + np.cumsum(self.count[large]) - self.count[large]
        self.first[large] = starts

    def own(self, cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return self.first[cells] + keys % self.count[cells]

    def blocks(self, cells: list[int]) -> dict[int, list[int]]:
        out = {}
        for c in cells:
            for block in range(int(self.first[c]), int(self.first[c] + self.count[c])):
                out.setdefault(block, []).append(c)
        return out


def _entries_dealt(layout: _Layout):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cells = batch.column("_cell").to_numpy()
            block = layout.own(cells, batch.column("_k2").to_numpy() & 0x7FFFFFFF)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(cells))
            made = [pa.array(np.zeros(n, np.int64)), pa.array(block), pa.array(np.zeros(n, np.int32)), *(batch.column(c) for c in ("_k1", "_k2", "_v", "_ids")), listed]
            yield pa.RecordBatch.from_arrays(made, ["_part", "_block", "_role", "_k1", "_k2", "_v", "_ids", "_cells"])

    return deal


def _queries_dealt(books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, layout: _Layout, enough: float, width: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, blocks, cells = [], [], []
                for i, query in enumerate(_numbers(part.column("_v"), width)):
                    for block, passed in layout.blocks(walk(query, books, sizes, enough)).items():
                        rows.append(i)
                        blocks.append(block)
                        cells.append(passed)
                n, asked = len(rows), part.take(pa.array(rows, pa.int64()))
                made = [pa.array(np.zeros(n, np.int64)), pa.array(blocks, pa.int64()), pa.array(np.ones(n, np.int32)), *(asked.column(c) for c in ("_k1", "_k2", "_v"))]
                yield pa.RecordBatch.from_arrays([*made, pa.nulls(n, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int64()))], ["_part", "_block", "_role", "_k1", "_k2", "_v", "_ids", "_cells"])

    return deal


def _reranked(width: int, wanted: int):
    """Of every query and block the entries that may be among the `wanted` best: exact scores in a fixed order of addition."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, _, table, rows in meetings(batches):
            if table is not held:
                held, entries = table, _numbers(table.column("_v"), width)
                cells, place = np.unique(_numbers(table.column("_cells"), 1)[:, 0], return_inverse=True)
                k1, k2, ids = (table.column(c).combine_chunks() for c in ("_k1", "_k2", "_ids"))
            for at in range(0, rows.num_rows, _ASKED_AT_ONCE):
                some = rows.slice(at, _ASKED_AT_ONCE)
                asked = _numbers(some.column("_v"), width)
                passed = np.zeros((len(asked), len(cells)), bool)
                lists = some.column("_cells")
                passed[np.repeat(np.arange(len(asked)), np.asarray(lists.value_lengths())), np.searchsorted(cells, lists.flatten().to_numpy())] = True
                scores = np.where(passed[:, place], asked @ entries.T, -np.inf)
                if len(entries) > wanted:
                    least = -np.partition(-scores, wanted - 1, axis=1)[:, wanted - 1]
                    # products of matrices may add in another order: keep what is as good but for rounding
                    slack = 1e-9 * np.sqrt((asked**2).sum(axis=1) * (entries**2).sum(axis=1).max())
                    keep = scores >= (least - slack)[:, None]
                else:
                    keep = np.ones(scores.shape, bool)
                q, x = np.nonzero(keep & (scores > -np.inf))
                exact = (asked[q] * entries[x]).sum(axis=1)
                pick, of = pa.array(x), pa.array(q)
                made = [some.column("_k1").take(of), some.column("_k2").take(of), pa.array(exact), ids.take(pick)]
                own = (np.asarray(k1)[x] == np.asarray(some.column("_k1"))[q]) & (np.asarray(k2)[x] == np.asarray(some.column("_k2"))[q])
                yield pa.RecordBatch.from_arrays([*made, pa.array(own)], ["_k1", "_k2", "score", "_ids", "_own"])

    return meet


def _smallest_ids(rows: DataFrame, many: int) -> DataFrame:
    """A row per vector, with its `many` smallest ids; cut before the shuffle."""
    place = F.row_number().over(W.partitionBy("_k1", "_k2").orderBy("_id"))
    few = rows.withColumn("_place", place).where(F.col("_place") <= many)
    return few.groupBy("_k1", "_k2").agg(F.any_value("_v").alias("_v"), F.array_sort(F.collect_list("_id")).alias("_ids"))


def neighbours(df: DataFrame, asked: Column, count: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where `asked` (on the id column) holds, their `count` nearest.

    `share`: the part of all entries that a query passes, measured on the sample if not given.
    """
    spark = df.sparkSession
    rows = _usable(df, id_col, vector_col)
    entries = stage(_smallest_ids(rows, count + 1), "vector-entries", _BATCH)
    total = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    sample = np.array([r["_v"] for r in entries.orderBy("_k1", "_k2").limit(SAMPLE).select("_v").collect()])
    width, k = sample.shape[1], int(max(1, min(MOST_CENTROIDS, len(sample), round((total / CELL) ** 0.5))))
    books = tuple(centroids(half, k) for half in _halves(sample))
    if share is None:
        share = share_needed(sample, books, max(1, round(count * len(sample) / total)))
    placed = stage(entries.mapInArrow(_in_cells(books, width), "_k1 long, _k2 long, _v array<double>, _ids array<long>, _cell long"), "vector-cells", _BATCH)
    sizes = np.zeros(k * k, np.int64)  # at most MOST_CENTROIDS squared
    for r in placed.groupBy("_cell").count().collect():
        sizes[r["_cell"]] = r["count"]
    layout, enough = _Layout(sizes), max(share * total, min(total, 2 * count + 1))

    queries = rows.where(asked).select(F.col("_id").alias("query_id"), "_k1", "_k2", "_v")
    distinct = queries.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n"), F.any_value("_v").alias("_v"))
    distinct = stage(distinct, "vector-queries", _BATCH)
    walks = distinct.select("_k1", "_k2", "_v").mapInArrow(_queries_dealt(books, sizes, layout, enough, width), _DEALT)
    met = dealt(placed.mapInArrow(_entries_dealt(layout), _DEALT).unionByName(walks))
    met = stage(met.mapInArrow(_reranked(width, count + 1), "_k1 long, _k2 long, score double, _ids array<long>, _own boolean"), "reranked", _BATCH)

    one_by_one = met.select("_k1", "_k2", "score", F.explode("_ids").alias("vec_id"), "_own")
    best = F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.col("score").desc(), "vec_id"))
    best = one_by_one.withColumn("_place", best).where(F.col("_place") <= count + 1)
    lists = best.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("_place", "vec_id", "score", "_own"))).alias("_found"))
    return _per_row(queries.drop("_v"), distinct.drop("_v"), lists, count).select("query_id", "rank", "vec_id", "score")


def _per_row(queries: DataFrame, distinct: DataFrame, lists: DataFrame, count: int) -> DataFrame:
    """The list of its vector for every query row, without the row itself.

    Rows of a vector with very many queries are dealt over copies of its list.
    """
    asked = distinct.agg(F.sum("_n")).first()[0] or 0
    limit = max(HOT, asked // HOT_SHARE)
    hot = stage(distinct.where(F.col("_n") > limit).select("_k1", "_k2", F.ceil(F.col("_n") / limit).alias("_times")), "hot-queries")  # at most HOT_SHARE rows
    keys = ["_k1", "_k2"]

    def spread(df: DataFrame, salt: Column) -> DataFrame:
        return df.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_times")

    left = spread(queries, F.coalesce(F.pmod(F.xxhash64("query_id"), F.col("_times")), F.lit(0)))
    right = spread(lists, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_times") - 1, F.lit(0)))))
    both = left.join(right, [*keys, "_salt"])
    itself = F.filter("_found", lambda f: f["_own"] & (f["vec_id"] == F.col("query_id")))
    own = F.when(F.size(itself) > 0, itself[0]["_place"]).otherwise(F.lit(count + 1))
    listed = both.select("query_id", own.alias("_at"), F.explode("_found").alias("_f")).where("_f._place != _at")
    rank = F.col("_f._place") - (F.col("_f._place") > F.col("_at")).cast("int")
    return listed.select("query_id", rank.cast("int").alias("rank"), F.col("_f.vec_id").alias("vec_id"), F.col("_f.score").alias("score"))


def search_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest of every row whose id is divisible by EVERY."""
    return neighbours(df, F.col("_id") % EVERY == 0, id_col=id_col, vector_col=vector_col)
