"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One inserted or deleted letter moves a word's vector of letter counts by one, a replaced letter
by one up and one down, so words one edit apart have an L1 distance of at most two, and only
words of equal length or of lengths one apart can be near.  For each length there is a tree
over the words of that length; words of the same length (one count up, one down) and of the
length below (one count up) search it.

A vector has DIMS counts (a letter each for a-z, A-Z shares them, the letters from U+00C0 on share the rest), counted up to LEVELS.
Written in unary, a count of three is three set bits, so a vector is 128 bits, distances are
popcounts of differing bits, a cut of a dimension at a value is one bit, and a box is the bits
that all its words have and the bits that any has.  Sharing and counting up to LEVELS only
shrink distances: boxes and leaves lose no near word, and the order of the letters is then
compared exactly.

The upper levels of a tree split a length with many words into cells of about CELL_WORDS words
or CELL_LETTERS letters, fitted on a bounded sample of hashes; every word has one home cell and
searches the cells its ball meets.  A cell that is still too large (many words with equal
vectors) is cut into blocks.  In a block a tree with tight boxes goes down to LEAF words, and
queries stream past it many at a time.  Nothing is capped; only sums leave a task: how many
near words, and the best one.

The form of a word leads to a word at least twice as frequent, so chains are short; roots are
found by pointer jumping.

Defined cases: null and empty texts hold no words; a null id is written as nothing in the
checksum; a run is read whole, whatever its length; ties between near words go to the smaller
in code-point order; repeated rows count as often as they stand there; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.blocks import dealt, meetings
from ledgerspark.llm.common import LOWER, UPPER, forget, stage, text_of
from ledgerspark.llm.wordtable import memory_returned, ranges

LEAST_LETTERS, LEAST_COUNT, DAMAGE, TIMES = 5, 3, 97, 2
#: Whole runs of letters that can give a word.
_RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_LOWER = str.maketrans(UPPER, LOWER)
#: Words that a task counts before it hands them on; texts of more characters are not listed run by run.
MOST_COUNTED, _LONG = 500_000, 1 << 20
DIMS, LEVELS = 32, 4
CELL_WORDS, CELL_LETTERS, LEAF = 50_000, 4_000_000, 32
#: Sampled words for each cell of a length, and the most cells of a length (blocks cut larger ones).
SAMPLE, MOST_CELLS = 32, 1024
#: Pairs that are compared at once, and rows of an Arrow batch.
_PAIRS, _BATCH, TEXT_ROWS = 1 << 20, 4096, 512
SAME, SHORTER = 1, 2

_DIM = np.zeros(256, np.int64)
_DIM[ord("a") : ord("z") + 1] = _DIM[ord("A") : ord("Z") + 1] = np.arange(26)
_DIM[0xC0:] = 26 + np.arange(0x40) % (DIMS - 26)


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points; all are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(rows: np.ndarray) -> np.ndarray:
    """Letter counts up to LEVELS in unary: two 64-bit numbers a word."""
    n = len(rows)
    counts = np.empty((n, DIMS), np.uint8)
    step = max(1, (1 << 22) // max(1, rows.shape[1]))
    for at in range(0, n, step):
        part = _DIM[rows[at : at + step]] + DIMS * np.arange(min(step, n - at))[:, None]
        counts[at : at + step] = np.minimum(np.bincount(part.ravel(), minlength=DIMS * min(step, n - at)).reshape(-1, DIMS), LEVELS)
    bits = (counts[:, None, :] >= np.arange(1, LEVELS + 1, dtype=np.uint8)[None, :, None]).reshape(n, DIMS * LEVELS)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _apart(a: np.ndarray, b: np.ndarray, rows: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of `a` and `b` whose vectors differ by at most `most`."""
    for word in (0, 1):
        close = np.bitwise_count(a[word][rows] ^ b[word][others]) <= most
        rows, others = rows[close], others[close]
    return rows, others


class Tree:
    """Nodes with boxes; a leaf covers a range of `order`.

    `bounded`: cells of a whole space, cut at the sample's medians, whose boxes hold every
    vector on their side of the cuts.  Otherwise boxes are tight around the vectors.
    """

    def __init__(self, found: np.ndarray, leaf: int, bounded: bool = False, most_leaves: int | None = None):
        self.low, self.high, self.left, self.right, self.bit, self.leaves = [], [], [], [], [], []
        order, starts = [], [0]
        depth = int(np.ceil(np.log2(most_leaves))) if most_leaves else None
        all_bits = np.full(2, 2**64 - 1, np.uint64)
        waiting = [(self._node(), np.arange(len(found)), np.zeros(2, np.uint64), all_bits, 0)]
        while waiting:
            at, rows, low, high, level = waiting.pop()
            mine = found[rows]
            if not bounded and len(rows):
                low, high = np.bitwise_and.reduce(mine, axis=0), np.bitwise_or.reduce(mine, axis=0)
            self.low[at], self.high[at] = low, high
            bit = self._cut(mine) if len(rows) > leaf and (depth is None or level < depth) else None
            if bit is None:
                self.leaves[at] = len(starts) - 1
                order.append(rows)
                starts.append(starts[-1] + len(rows))
                continue
            word, mask = bit // 64, np.uint64(1) << np.uint64(bit % 64)
            has = (mine[:, word] & mask) != 0
            without, with_it = high.copy(), low.copy()
            without[word] &= ~mask
            with_it[word] |= mask
            self.bit[at], self.left[at], self.right[at] = bit, self._node(), self._node()
            waiting += [(self.left[at], rows[~has], low, without, level + 1), (self.right[at], rows[has], with_it, high, level + 1)]
        self.order, self.starts = np.concatenate(order), np.array(starts)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.left, self.right, self.bit, self.leaves = (np.array(x, np.int64) for x in (self.left, self.right, self.bit, self.leaves))

    def _node(self) -> int:
        for column in (self.low, self.high):
            column.append(None)
        for column in (self.left, self.right, self.bit, self.leaves):
            column.append(-1)
        return len(self.left) - 1

    @staticmethod
    def _cut(mine: np.ndarray) -> int | None:
        """The dimension and value that halve the vectors best, None if all are equal."""
        bits = np.unpackbits(np.ascontiguousarray(mine[:2048]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bit = int(np.minimum(bits, len(mine[:2048]) - bits).argmax())
        if bits[bit] in (0, len(mine[:2048])):
            differing = np.bitwise_or.reduce(mine, axis=0) & ~np.bitwise_and.reduce(mine, axis=0)
            if not differing.any():
                return None
            bit = int(np.flatnonzero(np.unpackbits(differing.view(np.uint8), bitorder="little"))[0])
        return bit

    def home(self, queries: np.ndarray) -> np.ndarray:
        """The leaf that each vector lies in."""
        node = np.zeros(len(queries), np.int64)
        while (inner := np.flatnonzero(self.left[node] >= 0)).size:
            bit = self.bit[node[inner]]
            has = (queries[inner, bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1)
            node[inner] = np.where(has != 0, self.right[node[inner]], self.left[node[inner]])
        return self.leaves[node]

    def search(self, queries: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all boxes within `up` counts more and `down` counts less."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        asked, low, high = (np.ascontiguousarray(x.T) for x in (queries, self.low, self.high))
        out = []
        while len(query):
            more, less = np.zeros(len(query), np.uint8), np.zeros(len(query), np.uint8)
            for word in (0, 1):
                q = asked[word][query]
                more += np.bitwise_count(low[word][node] & ~q)
                less += np.bitwise_count(q & ~high[word][node])
                near = (more <= up) & (less <= down)
                query, node, more, less = query[near], node[near], more[near], less[near]
            leaf = self.leaves[node] >= 0
            out.append((query[leaf], self.leaves[node[leaf]]))
            query, node = query[~leaf], node[~leaf]
            query, node = np.concatenate([query, query]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate([q for q, _ in out]), np.concatenate([leaf for _, leaf in out])


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters are one edit apart: equal lengths, or `b` one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    begins = np.logical_and.accumulate(a == b[:, :-1], axis=1)
    ends = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1)
    return begins.sum(axis=1) + ends.sum(axis=1) >= a.shape[1]


class Block:
    """The words of a block with their tree."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.letters = letters(words)
        found = vectors(self.letters)
        self.tree = Tree(found, LEAF)
        self.rows, self.found = self.tree.order, np.ascontiguousarray(found[self.tree.order].T)
        self.words, self.counts = words, counts

    def near(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs one edit apart, some at a time; queries are as long or one shorter."""
        found = vectors(rows)
        up, down = 1, int(rows.shape[1] == self.letters.shape[1])
        query, leaf = self.tree.search(found, up, down)
        found = np.ascontiguousarray(found.T)
        start, size = self.tree.starts[leaf], np.diff(self.tree.starts)[leaf]
        fit = max(1, _PAIRS // max(1, rows.shape[1] // 64))
        ends = np.cumsum(size)
        cuts = (np.searchsorted(ends, np.arange(fit, int(ends[-1]) + fit, fit)) + 1).tolist() if len(ends) else [0]
        for i, j in zip([0, *cuts[:-1]], cuts, strict=True):
            if i >= j:
                continue
            q = np.repeat(query[i:j], size[i:j])
            x = ranges(np.arange(len(self.rows)), start[i:j], size[i:j])
            q, x = _apart(found, self.found, q, x, up + down)
            x = self.rows[x]
            exact = _one_edit(rows[q], self.letters[x])
            yield q[exact], x[exact]


def _best(to: np.ndarray, other: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of `to`: itself, its number of pairs, and the partner of largest count, ties to the smallest rank."""
    order = np.lexsort((rank[other], -counts[other], to))
    to, other = to[order], other[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return to[first], np.diff(np.r_[first, len(to)]), other[first]


def _rank(words: list[str]) -> np.ndarray:
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return rank


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`word`, `_near`, `_best_n`, `_best`: partial sums, for queries and (of the shorter ones) for the words they found."""
    held, block = None, None
    for _, role, table, rows in meetings(batches):
        if table is not held:
            held = table
            words = table.column("word").combine_chunks()
            block = Block(words.to_pylist(), table.column("n").to_numpy())
            rank = _rank(block.words)
        asked, asked_n = rows.column("word"), rows.column("n").to_numpy()
        listed = asked.to_pylist()
        for q, x in block.near(letters(listed)):
            if len(q):
                yield _partial(asked, words, block.counts, *_best(q, x, block.counts, rank))
                if role == SHORTER:
                    yield _partial(words, asked, asked_n, *_best(x, q, asked_n, _rank(listed)))


def _partial(words: pa.Array, others: pa.Array, counts: np.ndarray, to: np.ndarray, near: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    made = [words.take(pa.array(to)), pa.array(near, pa.int64()), pa.array(counts[best], pa.int64()), others.take(pa.array(best))]
    return pa.RecordBatch.from_arrays(made, ["word", "_near", "_best_n", "_best"])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(length, rows, words) of a batch."""
    lengths = pc.utf8_length(batch.column("word")).to_numpy()
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield n, rows, batch.column("word").take(pa.array(rows))


def _homes(trees: dict[int, Tree]):
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, words in _by_length(batch):
                cell = trees[n].home(vectors(letters(words.to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), n, np.int64)), pa.array(cell)], ["_part", "_cell"])

    return homes


_DEALT = "_part long, _block long, _role int, word string, n long"


def _deal(trees: dict[int, Tree], blocks: dict[tuple[int, int], int], spread: int):
    """Every word to its home block, and as a query to all blocks of the cells its ball meets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_of = batch.column("n").to_numpy()
            for size, rows, words in _by_length(batch):
                found, n = vectors(letters(words.to_pylist())), n_of[rows]
                everyone = np.arange(len(words))
                home = trees[size].home(found) if size in trees else np.zeros(len(words), np.int64)
                yield _dealt_batch(size, 0, everyone, home, _own_block(size, home, words, blocks), spread, words, n)
                for role, up, down, part in ((SAME, 1, 1, size), (SHORTER, 1, 0, size + 1)):
                    query, cell = trees[part].search(found, up, down) if part in trees else (everyone, np.zeros(len(words), np.int64))
                    yield from (_dealt_batch(part, role, q, c, b, spread, words, n) for q, c, b in _all_blocks(part, query, cell, blocks))

    return deal


def _own_block(part: int, cell: np.ndarray, words: pa.Array, blocks: dict[tuple[int, int], int]) -> np.ndarray:
    """The block of a word's home cell: its checksum picks one where a cell has several."""
    own = np.zeros(len(cell), np.int64)
    for (length, large), count in blocks.items():
        if length == part:
            for i in np.flatnonzero(cell == large).tolist():
                own[i] = zlib.crc32(words[i].as_py().encode()) % count
    return own


def _all_blocks(part: int, query: np.ndarray, cell: np.ndarray, blocks: dict[tuple[int, int], int]) -> Iterator[tuple]:
    yield query, cell, np.zeros(len(query), np.int64)
    for (length, large), count in blocks.items():
        if length == part:
            for extra in range(1, count):
                hit = cell == large
                yield query[hit], cell[hit], np.full(int(hit.sum()), extra)


def _dealt_batch(part: int, role: int, rows: np.ndarray, cell: np.ndarray, block: np.ndarray, spread: int, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    made = [pa.array(np.full(len(rows), part, np.int64)), pa.array(cell * spread + block), pa.array(np.full(len(rows), role, np.int32)), words.take(pa.array(rows)), pa.array(n[rows])]
    return pa.RecordBatch.from_arrays(made, ["_part", "_block", "_role", "word", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`word`, `n`: what the runs of a text leave, added up for MOST_COUNTED of them at a time.

    A run's checksum goes on from that of what stands before it.
    """
    with memory_returned():
        words, counts, crc32 = [], [], zlib.crc32
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = Counter((m[0] for m in _RUN.finditer(text)) if len(text) > _LONG else _RUN.findall(text))
                start = crc32(f"{doc}:".encode())
                for run in found:
                    run = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = crc32(run.encode(), start)
                    words.append(run if h % DAMAGE else run[: h % len(run)] + run[h % len(run) + 1 :])
                counts += found.values()
                if len(words) > MOST_COUNTED:
                    yield from _added_up(words, counts)
                    words, counts = [], []
        yield from _added_up(words, counts)


def _added_up(words: list[str], counts: list[int]) -> list[pa.RecordBatch]:
    table = pa.table([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])
    sums = table.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"word": "word", "n_sum": "n"}).select(["word", "n"])
    return sums.filter(pc.greater_equal(pc.utf8_length(sums.column("word")), LEAST_LETTERS)).combine_chunks().to_batches()


def words_of_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`word`, `n`) of the words long and frequent enough, damaged runs included as what is left of them."""
    texts = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), text_of(text_col).alias("_text"))
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame, cell_words: int = CELL_WORDS, cell_letters: int = CELL_LETTERS) -> DataFrame:
    """(`word`, `_near`, `_best_n`, `_best`) of the words of the staged table (`word`, `n`) that have near ones."""

    def room(length: int) -> int:
        return max(1, min(cell_words, cell_letters // length))

    lengths = words.groupBy(F.length("word").alias("_part")).agg(F.count(F.lit(1)).alias("_words"))
    cap = F.greatest(F.lit(1), F.least(F.lit(cell_words), F.floor(F.lit(cell_letters) / F.col("_part"))))
    # only lengths with more words than a cell holds come to the driver: at most words / cell_words of usual length
    large = {r["_part"]: min(MOST_CELLS, -(-r["_words"] // room(r["_part"]))) / r["_words"] for r in lengths.where(F.col("_words") > cap).collect()}
    trees, blocks = {}, {}
    if large:
        share = words.sparkSession.createDataFrame([(n, 2 * SAMPLE * x) for n, x in large.items()], "_part long, _share double")
        listed = words.withColumn("_part", F.length("word").cast("long")).join(F.broadcast(share), "_part")
        drawn = listed.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.col("_share") * (1 << 30)).select("_part", "word").collect()
        for n in large:
            sample = sorted(r["word"] for r in drawn if r["_part"] == n)
            trees[n] = Tree(vectors(letters(sample)) if sample else np.zeros((0, 2), np.uint64), SAMPLE, bounded=True, most_leaves=MOST_CELLS)
        homes = listed.select("word").mapInArrow(_homes(trees), "_part long, _cell long").groupBy("_part", "_cell").agg(F.count(F.lit(1)).alias("_words"))
        heavy = homes.join(F.broadcast(share.select("_part")), "_part").where(F.col("_words") > 2 * cap).collect()
        blocks = {(r["_part"], r["_cell"]): -(-r["_words"] // room(r["_part"])) for r in heavy}
    spread = max([1, *blocks.values()])
    met = dealt(words.select("word", "n").mapInArrow(_deal(trees, blocks, spread), _DEALT)).mapInArrow(_met, "word string, _near long, _best_n long, _best string")
    best = F.min(F.struct((-F.col("_best_n")).alias("_n"), F.col("_best").alias("_word")))
    out = stage(met, "near-words", _BATCH).groupBy("word").agg(F.sum("_near").alias("_near"), best.alias("_top"))
    return out.select("word", "_near", (-F.col("_top._n")).alias("_best_n"), F.col("_top._word").alias("_best"))


def roots(forms: DataFrame) -> DataFrame:
    """(`word`, `root`) for (`word`, `form`): the end of the chain of forms, by pointer jumping."""
    reach, left = stage(forms.select("word", F.col("form").alias("root")), "roots"), None
    while left != 0:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = stage(reach.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        left = longer.where("_moved").limit(1).count()
        forget(reach)
        reach = longer.select("word", "root")
    return reach


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_words: int = CELL_WORDS, cell_letters: int = CELL_LETTERS) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n."""
    words = stage(words_of_corpus(df, id_col, text_col), "words", TEXT_ROWS)
    near = near_words(words, cell_words, cell_letters)
    sure = F.col("_best_n") >= TIMES * F.col("n")
    full = words.join(near, "word", "left").select("word", "n", F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"), F.when(sure, F.col("_best")).alias("form"), F.when(sure, F.col("_best_n")).alias("form_n"))
    full = stage(full, "word-forms")
    ends = roots(full.where("form is not null").select("word", "form"))
    return full.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
