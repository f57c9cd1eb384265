"""Near-duplicate detection: MinHash with banding, verification, connected components.

1. Every whole text becomes its set of distinct five-word shingles, HASHES universal hash
   minima, and a key of the whole set.  Texts with the same set are one node from here on,
   so thousands of copies cost no pairs.
2. BANDS bands of ROWS minima each give bucket keys.  At a similarity of 0.75 a pair shares
   a bucket with probability 1 - (1 - 0.75**ROWS)**BANDS, above 0.9999.
3. Within a bucket every node is linked to the bucket's smallest node only (a star).  Linked
   pairs are verified: first by signature (five standard deviations of slack), then exactly
   on the full sets.  Components of the verified links are found by alternating large-star
   and small-star steps.
4. A bucket whose nodes ended in different components may still hide a link that no star
   tested.  There, the nodes outside the bucket's most common component meet all nodes of
   the bucket in blocks, whose sets are compared exactly, and components are found once
   more.  After that every pair that shares a bucket is tested or known to be connected.

Nothing is capped, and no group is gathered in one task: buckets are joined, not collected,
and copies of a set are cut before the shuffle and joins on hot keys can be split.

Defined cases: a null text or one without words has the empty set, is linked with nothing
and stays; fewer than five words are one shingle, the whole sequence; a null id never wins
over another id; an empty table gives an empty result; repeated rows share one component
(`without_near_copies` keeps exactly one row of each component, and every row without
words).  Further columns pass through `without_near_copies` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import stage
from ledgerspark.llm.wordtable import memory_returned

SHINGLE, SIMILARITY = 5, 75
ROWS, BANDS = 6, 52
HASHES = ROWS * BANDS
#: Agreeing minima that a pair at the threshold has at least, but for one in a million.
LEAST_AGREEING = int(HASHES * 0.75 - 5 * (HASHES * 0.75 * 0.25) ** 0.5)
#: Nodes of a bucket that are compared at once.
BLOCK = 128
_CACHED_WORDS = 100_000
#: Rows of an Arrow batch: texts, and pairs of blocks.
TEXT_ROWS, BLOCK_PAIRS = 512, 8

_random = np.random.default_rng(20240607)
_MULTIPLY = (_random.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
_BAND_MULTIPLY = _random.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    bytes.split() and bytes.lower() know exactly the six ASCII spaces and A-Z.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out) + h[i : i + len(out)]
    return np.unique(_mixed(out))


def minima(found: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-add hashes modulo 2**32, a few thousand shingles at a time."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(best, (low[i : i + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=best)
    return best


def _band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mixed(keys) + rows[:, i] * _BAND_MULTIPLY[i]
    return _mixed(keys).view(np.int64)


SKETCH = "_id long, _hash long, _n long, _node long, _sig binary, _bands array<long>"


def _node_of(found: np.ndarray) -> int | None:
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "little", signed=True) if len(found) else None


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with memory_returned():
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, node, sig, bands = [], [], [], []
                for text in part.column(2).to_pylist():
                    found = shingles(text, hashes)
                    best = minima(found) if len(found) else None
                    n.append(len(found))
                    node.append(_node_of(found))
                    sig.append(None if best is None else best.astype(np.uint8).tobytes())
                    bands.append(None if best is None else _band_keys(best))
                made = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["_id", "_hash", "_n", "_node", "_sig", "_bands"])
        del hashes


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with memory_returned():
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = [shingles(t, hashes) for t in batch.column(0).slice(at, 64).to_pylist()]
                made = [pa.array([_node_of(f) for f in found], pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["_node", "_shingles"])
        del hashes


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (`_u`, `_v`, both signatures) whose signatures agree often enough."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= LEAST_AGREEING)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["_u", "_v"])


def _rows(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return df.select(*more, F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


def _sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(`_node`, `_shingles`) of the wanted nodes, made again from one text each."""
    wanted = wanted.join(nodes.select("_node", "_id", "_hash"), "_node").select(F.col("_id").alias("_wid"), F.col("_hash").alias("_wh"))
    chosen = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_hash") == F.col("_wh")), "left_semi")
    return chosen.select("_text").mapInArrow(_sets, "_node long, _shingles array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of nodes (`_u`, `_v`) whose full sets are similar enough."""
    sig = nodes.select("_node", "_sig")
    signed = pairs.join(sig.withColumnsRenamed({"_node": "_u", "_sig": "_a"}), "_u").join(sig.withColumnsRenamed({"_node": "_v", "_sig": "_b"}), "_v")
    likely = stage(signed.select("_u", "_v", "_a", "_b").mapInArrow(_agreeing, "_u long, _v long"), "likely-pairs")
    sets = _sets_of(likely.select("_u").union(likely.select("_v")).select(F.col("_u").alias("_node")).distinct(), nodes, texts)
    both = likely.join(sets.withColumnsRenamed({"_node": "_u", "_shingles": "_a"}), "_u").join(sets.withColumnsRenamed({"_node": "_v", "_shingles": "_b"}), "_v")
    common = F.size(F.array_intersect("_a", "_b"))
    similar = both.withColumn("_common", common).where(100 * F.col("_common") >= SIMILARITY * (F.size("_a") + F.size("_b") - F.col("_common")))
    return stage(similar.select("_u", "_v").distinct(), "links", TEXT_ROWS)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("_u", "_v").union(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
    least = both.groupBy("_u").agg(F.least("_u", F.min("_v")).alias("_m"))
    return both.where("_v > _u").join(least, "_u").where("_v != _m").select(F.col("_m").alias("_u"), "_v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """`edges` have `_u` < `_v`."""
    least = edges.groupBy("_v").agg(F.min("_u").alias("_m"))
    joined = edges.join(least, "_v")
    moved = joined.where("_u != _m").select(F.col("_m").alias("_u"), F.col("_u").alias("_v"))
    return moved.union(joined.select(F.col("_m").alias("_u"), "_v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_u", "_v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(`_v`, `_u`): every linked node but the smallest of its component, with that smallest node.

    Large-star and small-star steps alternate until no edge changes; each round is staged.
    """
    edges, before = links.select(F.least("_u", "_v").alias("_u"), F.greatest("_u", "_v").alias("_v")).where("_u != _v").distinct(), None
    while True:
        edges = stage(_small_star(_large_star(edges)), "stars")
        now = _state(edges)
        if now == before or not now[0]:
            return edges
        before = now


def _with_component(rows: DataFrame, stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("_v").alias("_node"), F.col("_u").alias("_root"))
    return rows.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a bucket: for each node of the first, one to each other component of the second.

    The sets of the second block lie end to end; one probe gives a node's overlap with all of them.
    """
    for batch in batches:
        out_u, out_v = [], []
        for some, others in zip(batch.column(0), batch.column(1), strict=True):
            nodes, roots, sets, ends = _block(others)
            sizes = np.diff(ends)
            for node, root, mine in zip(*_members(some), strict=True):
                at = np.minimum(np.searchsorted(mine, sets), len(mine) - 1)
                common = np.add.reduceat((mine[at] == sets).astype(np.int64), ends[:-1])
                hit = np.flatnonzero((100 * common >= SIMILARITY * (sizes + len(mine) - common)) & (roots != root))
                _, one = np.unique(roots[hit], return_index=True)
                out_u += [node] * len(one)
                out_v += nodes[hit[one]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["_u", "_v"])


def _block(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, roots, sets end to end, and the borders of the sets."""
    values = cell.values
    sets = values.field("_shingles")
    ends = sets.offsets.to_numpy()
    return values.field("_node").to_numpy(), values.field("_root").to_numpy(), sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends - ends[0]


def _members(cell: pa.ListScalar) -> tuple[list[int], list[int], list[np.ndarray]]:
    nodes, roots, sets, ends = _block(cell)
    return nodes.tolist(), roots.tolist(), [sets[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _hidden_links(shared: DataFrame, stars: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links inside buckets that still hold several components.

    Nodes outside the bucket's most common component meet all its nodes in blocks: rows pair
    blocks, never nodes, and sets are compared exactly.  A bucket of two was settled by its star.
    """
    placed = stage(_with_component(shared.select("_band", "_node"), stars), "placed")
    counts = placed.groupBy("_band").agg(F.min("_root").alias("_r0"), F.max("_root").alias("_r1"), F.count(F.lit(1)).alias("_k"))
    open_rows = stage(placed.join(counts.where("_r0 != _r1 and _k > 2").select("_band", "_k"), "_band"), "open-buckets")
    per_root = open_rows.groupBy("_band", "_root").agg(F.count(F.lit(1)).alias("_same"))
    usual = per_root.groupBy("_band").agg(F.max_by("_root", F.struct("_same", "_root")).alias("_usual"))
    sets = stage(_sets_of(open_rows.select("_node").distinct(), nodes, texts), "open-sets", TEXT_ROWS)
    blocks = F.ceil(F.col("_k") / BLOCK).cast("long")
    full = open_rows.join(sets, "_node").join(usual, "_band").withColumn("_block", F.pmod(F.xxhash64("_node"), blocks))
    member = F.collect_list(F.struct("_node", "_root", "_shingles"))
    every = full.groupBy("_band", "_block").agg(member.alias("_others"))
    rare = full.where("_root != _usual").groupBy("_band", "_block").agg(member.alias("_some")).select("_band", "_some")
    met = rare.join(every, "_band").select("_some", "_others").mapInArrow(_block_links, "_u long, _v long")
    return stage(met.select(F.least("_u", "_v").alias("_u"), F.greatest("_u", "_v").alias("_v")).distinct(), "hidden-links", BLOCK_PAIRS)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One staged row per input row: `_id`, `_hash` of the text, `_n` shingles, `_component` (smallest id)."""
    rows = stage(_rows(df, id_col, text_col).mapInArrow(_sketches, SKETCH), "sketches", TEXT_ROWS)
    texts = _rows(df, id_col, text_col)
    place = F.row_number().over(W.partitionBy("_node").orderBy(F.col("_id").asc_nulls_last(), "_hash"))
    nodes = stage(rows.where("_node is not null").withColumn("_place", place).where("_place = 1").drop("_place"), "nodes")
    in_bands = nodes.select("_node", F.explode("_bands").alias("_band"))
    buckets = in_bands.groupBy("_band").agg(F.min("_node").alias("_least"), F.max("_node").alias("_most")).where("_least != _most")
    shared = stage(in_bands.join(buckets.select("_band", "_least"), "_band"), "buckets")

    tested = stage(shared.where("_node != _least").select(F.col("_least").alias("_u"), F.col("_node").alias("_v")).distinct(), "star-pairs")
    links = _verified(tested, nodes, texts)
    stars = components(links)

    more = _hidden_links(shared, stars, nodes, texts)
    if not more.isEmpty():
        stars = components(stars.select("_u", "_v").union(more))

    labels = _with_component(nodes.select("_node", "_id"), stars)
    smallest = labels.groupBy("_root").agg(F.min("_id").alias("_component"))
    labels = labels.join(smallest, "_root").select("_node", "_component")
    out = rows.select("_id", "_hash", "_n", "_node").join(labels, "_node", "left")
    return stage(out.select("_id", "_hash", "_n", F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id")).alias("_component")), "near-groups")


def near_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    out = near_groups(df, id_col, text_col)
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, one of each component."""
    groups = near_groups(df, id_col, text_col)
    place = F.row_number().over(W.partitionBy("_component").orderBy(F.col("_id").asc_nulls_last(), "_hash"))
    first = groups.where("_n > 0").withColumn("_place", place).where("_place = 1").select("_id", "_hash", F.lit(True).alias("_stay"))
    keys = groups.where("_n > 0").groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_times"))
    marked = keys.join(first.withColumnsRenamed({"_id": "_i", "_hash": "_h"}), F.expr("_id <=> _i and _hash <=> _h"), "left").drop("_i", "_h")
    marked = stage(marked.where("_stay is null or _times > 1").select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_stay", F.lit(True).alias("_hit")), "near-losers")
    left = _rows(df, id_col, text_col, F.struct("*").alias("_row")).drop("_text").join(marked, F.expr("_id <=> _i and _hash <=> _h"), "left")
    alone = left.where("_hit is null").select("_row.*")
    repeated = left.where("_stay").withColumn("_place", F.row_number().over(W.partitionBy("_id", "_hash").orderBy(F.lit(0)))).where("_place = 1").select("_row.*")
    return alone.unionByName(repeated) if not marked.where("_stay").isEmpty() else alone
