"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are sorted by id over ordered partitions; a task encodes its texts and packs them
into shards of about SHARD_IDS ids.  In each shard frequent neighbouring ids are replaced by
new symbols, round after round.  A round takes all pairs that occur at least half as often as
the most frequent one (all frequent ones from the third round on) and replaces occurrences
that do not overlap, from left to right.  Pairs never reach across documents.  A shard holds the rules, the expansion length of every
rule, where each document starts, and the remaining symbols: any span of any document is
decoded without touching the others, skipping over symbols by their lengths.

A partition is written as one file by the text sink, a shard a row; a shard starts with its
own length, so nothing depends on the separator.  Files are read back whole, one task each,
and are as small as the partitions.

Texts are cut at ASCII white space, which no token of this tokenizer family crosses, and
a distinct word (of words that differ in case only, where the tokenizer lower-cases, one)
is given to the tokenizers library once while a worker's table has room;
new words go there many at a time, between separators.  The ids are those of the whole text.

Defined cases: null and empty texts have just the end id; null ids come first; rows with the
same id keep a fixed order (by a hash of their text); a text longer than a shard is a shard of
its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from ledgerspark.llm.common import new_folder, stage
from ledgerspark.llm.wordtable import WordTable, memory_returned, ranges, runs

END_ID, SHARD_IDS, LEAST_COUNT = 1, 1 << 20, 16
_HEAD = struct.Struct("<4sQIIIQQ")  # magic, length of all, documents, rules, first new symbol, symbols, ids
_MAGIC = b"RPS1"
#: Words a worker keeps, words given to the library as one text, bytes of the texts coded at a time.
WORDS_KEPT, WORDS_A_TEXT, CODED_BYTES = 1_200_000, 512, 3 << 21
_SLOTS = 1 << 18
#: A character that is a token of its own and separates the words of such a text.
_BETWEEN = "\x01"


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs ^ (pairs >> 26)) & (_SLOTS - 1)


def grammar(ids: np.ndarray, last: np.ndarray, first_new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last-of-document marks, rules) of `ids`; `last` marks the end of each document.

    Rounds go on until no pair within a document occurs LEAST_COUNT times.
    """
    seq, rules = ids.astype(np.int64), [np.empty((0, 2), np.int64)]
    made, newest = 0, 0
    for turn in count():
        if len(seq) < 2:
            break
        # after a round that took all frequent pairs, only pairs with one of its symbols can be frequent
        inside = ~last[:-1] if turn < 3 else ~last[:-1] & ((seq[:-1] >= newest) | (seq[1:] >= newest))
        spot = np.flatnonzero(inside)
        code = (seq[spot] << 32) | seq[spot + 1]
        # a pair occurs no oftener than its slot
        slot = _slot(code)
        ordered = np.sort(code[(np.bincount(slot, minlength=_SLOTS) >= LEAST_COUNT)[slot]])
        if not len(ordered):
            break
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts, pairs = np.diff(np.append(starts, len(ordered))), ordered[starts]
        usable = counts >= LEAST_COUNT
        if not usable.any():
            break
        counts, pairs = counts[usable], pairs[usable]
        chosen = np.flatnonzero(counts >= (counts.max() // 2 if turn < 2 else LEAST_COUNT))
        pairs = pairs[chosen]
        # most neighbours are no chosen pair; a small table of places says which one each may be, and pairs that share a slot are searched for
        slots = _slot(pairs)
        place, shared = np.full(_SLOTS, -1, np.int32), np.bincount(slots, minlength=_SLOTS) > 1
        place[slots] = np.arange(len(pairs))
        at = place[slot]
        hit = np.flatnonzero(at >= 0)
        at, found = at[hit].astype(np.int64), code[hit]
        same = pairs[at] == found
        unsure = np.flatnonzero(~same & shared[slot[hit]])
        at[unsure] = np.minimum(np.searchsorted(pairs, found[unsure]), len(pairs) - 1)
        same[unsure] = pairs[at[unsure]] == found[unsure]
        hit, at = spot[hit[same]], at[same]
        # every second one of a run of overlapping occurrences
        fresh = np.concatenate([[True], np.diff(hit) > 1])
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        second = (np.arange(len(hit)) - run_start) % 2 == 1
        hit, at = hit[~second], at[~second]
        newest = first_new + made
        seq[hit] = newest + at
        last[hit] = last[hit + 1]
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        seq, last = seq[stay], last[stay]
        rules.append(np.column_stack([pairs >> 32, pairs & 0xFFFFFFFF]))
        made += len(pairs)
    return seq, last, np.concatenate(rules)


def _lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    """Ids that each rule expands to; rules only use earlier symbols."""
    out = np.ones(len(rules), np.int64)
    while True:
        size = np.where(rules >= first_new, out[np.maximum(rules - first_new, 0)], 1).sum(axis=1) if len(rules) else out
        if (size == out).all():
            return out
        out = size


def pack(doc_ids: list[int | None], texts: list[np.ndarray], first_new: int) -> bytes:
    """One shard of these documents' ids."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.concatenate(texts).astype(np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    seq, ends, rules = grammar(ids, last, first_new)
    borders = np.flatnonzero(ends) + 1
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8"), known, sizes.astype("<u8"), borders.astype("<u8"), rules.astype("<u4"),
        _lengths(rules, first_new).astype("<u4"), seq.astype("<u4"),
    ]
    body = b"".join(p.tobytes() for p in parts)
    return _HEAD.pack(_MAGIC, _HEAD.size + len(body), len(texts), len(rules), first_new, len(seq), len(ids)) + body


class Shard:
    """A packed shard; documents are decoded alone."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.size, docs, rules, self.first_new, symbols, self.n_ids = _HEAD.unpack_from(data, at)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at += _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.sizes, self.borders = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.rules, self.lengths = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64), take("<u4", rules).astype(np.int64)
        self.symbols = take("<u4", symbols)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.int64)
        while (new := np.flatnonzero(seq >= self.first_new)).size:
            repeat = np.ones(len(seq), np.int64)
            repeat[new] = 2
            spot = (np.cumsum(repeat) - repeat)[new]
            rule = self.rules[seq[new] - self.first_new]
            seq = np.repeat(seq, repeat)
            seq[spot], seq[spot + 1] = rule[:, 0], rule[:, 1]
        return seq

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids[start:stop] of a document; only the symbols that cover the span are expanded."""
        seq = self.symbols[self.borders[doc - 1] if doc else 0 : self.borders[doc]].astype(np.int64)
        stop = int(self.sizes[doc]) if stop is None else min(stop, int(self.sizes[doc]))
        if start >= stop:
            return np.empty(0, np.uint32)
        size = np.where(seq >= self.first_new, self.lengths[np.maximum(seq - self.first_new, 0)] if len(self.lengths) else 1, 1)
        ends = np.cumsum(size)
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[i - 1]) if i else 0
        return self._expand(seq[i:j])[start - skipped : stop - skipped].astype(np.uint32)

    def all_ids(self) -> list[np.ndarray]:
        # each rule is expanded once, then every symbol is a range of what ids and rules stand for
        table = np.concatenate([np.arange(self.first_new), self._expand(self.first_new + np.arange(len(self.rules)))]).astype("<u4")
        lengths = np.concatenate([np.ones(self.first_new, np.int64), self.lengths])
        starts = np.cumsum(lengths) - lengths
        return np.split(ranges(table, starts[self.symbols], lengths[self.symbols]), np.cumsum(self.sizes)[:-1])


@lru_cache(maxsize=1)
def table_of(tokenizer: str) -> tuple[WordTable, int]:
    """Word table of a tokenizer and the first free symbol; one a worker, it outlasts a task."""
    coder = Tokenizer.from_str(tokenizer)

    def alone(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)]

    between = alone([_BETWEEN])[0]
    # the separator must be one id, which then stands for this character and nothing else
    joins = len(between) == 1 and alone([f"ab {_BETWEEN} c. {_BETWEEN} d"])[0].count(between[0]) == 2

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for i in range(0, len(words), WORDS_A_TEXT):
            names = [w.decode("utf-8", "replace") for w in words[i : i + WORDS_A_TEXT]]
            if joins and not any(_BETWEEN in w for w in names):
                found = np.array(alone([f" {_BETWEEN} ".join(names)])[0], np.uint32)
                cuts = np.flatnonzero(found == between[0])
                if len(cuts) != len(names) - 1:
                    raise ValueError("words and separators of a text don't match")
                ids.append(found[found != between[0]])
                lengths.append(np.diff(cuts, prepend=-1, append=len(found)) - 1)
            else:
                each = alone(names)
                ids.append(np.array([x for e in each for x in e], np.uint32))
                lengths.append(np.array([len(e) for e in each], np.int64))
        return np.concatenate(ids), np.concatenate(lengths)

    return WordTable(encode, np.uint32, WORDS_KEPT), max(coder.get_vocab_size(with_added_tokens=True), END_ID + 1)


def words_in(texts: pa.Array) -> pa.Array:
    """Per text its words between ASCII white space (an empty one before or after such space), in bytes as they are."""
    return pc.ascii_split_whitespace(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()))


@lru_cache(maxsize=1)
def keys_of(tokenizer: str) -> Callable[[pa.Array], list[bytes]]:
    """How distinct words become keys of the table: in lower case where the tokenizer makes no difference.

    That is so for ASCII words if its normalizer lower-cases and else only composes characters and replaces
    white space, save for words that hold an added token, which may be sought in the text as given.
    """
    rules = json.loads(tokenizer)
    steps = rules.get("normalizer") or {}
    steps = steps.get("normalizers", []) if steps.get("type") == "Sequence" else [steps]
    kinds = {"Replace-space" if s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} else s.get("type") for s in steps}
    added = [t["content"].lower() for t in rules.get("added_tokens") or []]
    if "Lowercase" not in kinds or kinds - {"Lowercase", "NFC", "NFD", "NFKC", "NFKD", "Replace-space"} or len(added) > 16 or not all(map(str.isascii, added)):
        return _bytes

    def keys(words: pa.Array) -> list[bytes]:
        lower = pc.ascii_lower(words)
        alike = pc.string_is_ascii(words)
        for content in added:
            alike = pc.and_not(alike, pc.match_substring(lower, content))
        return _bytes(pc.if_else(alike, lower, words))

    return keys


def _bytes(words: pa.Array) -> list[bytes]:
    """The words (none null) as bytes; cut from one buffer, which is faster than to_pylist."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, kind)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in pairwise(ends)]


def write_shards(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts with a tokenizer (its JSON text) and write them in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            (table, first_new), keys = table_of(tokenizer), keys_of(tokenizer)
            end = np.array([END_ID], np.uint32)
            ids, texts, total = [], [], 0
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                for part in runs(sizes, CODED_BYTES):
                    names, words = batch.column(0)[part].to_pylist(), words_in(batch.column(1)[part])
                    for name, found in zip(names, table.lookup(words.flatten(), pc.fill_null(pc.list_value_length(words), 0).to_numpy(), keys), strict=True):
                        ids.append(name)
                        texts.append(np.concatenate([found, end]))
                        total += len(found) + 1
                        if total >= shard_ids:
                            yield pa.RecordBatch.from_arrays([pa.array([pack(ids, texts, first_new)], pa.binary())], ["value"])
                            ids, texts, total = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([pack(ids, texts, first_new)], pa.binary())], ["value"])

    text = F.col(text_col).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    ordered = rows.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, before = data.as_py(), 0, 0
                while at < len(data):
                    shard = Shard(data, at)
                    found = shard.all_ids()
                    starts = before + np.cumsum(shard.sizes) - shard.sizes
                    made = [pa.array([path] * len(found)), pa.array(shard.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.sizes, pa.int64()), pa.array([zlib.crc32(f.tobytes()) for f in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays(made, ["_path", "doc_id", "_start", "n_tokens", "ids_crc32"])
                    before += int(shard.sizes.sum())
                    at += shard.size + 1  # the line separator

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    docs = files.mapInArrow(run, "_path string, doc_id long, _start long, n_tokens long, ids_crc32 long")
    docs = docs.withColumn("_part", F.regexp_extract("_path", r"part-(\d+)", 1).cast("long")).drop("_path")
    return docs


def shard_report(df: DataFrame, tokenizer: str, folder: str | None = None, **columns: str) -> DataFrame:
    """Write the ids of `df` and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or new_folder(df.sparkSession, "token-shards")
    write_shards(df, folder, tokenizer, **columns)
    docs = stage(read_shards(df.sparkSession, folder), "token-documents")
    # one row per file: files follow the order of ids
    sums = docs.groupBy("_part").agg(F.sum("n_tokens").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select("_part", before.alias("_before"))
    return docs.join(parts, "_part").select("doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")
