"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Words of equal length advance together, one row of a matrix each.  At every end position the
substrings of all lengths are hashed from prefix hashes and looked up among the sorted
hashes of the pieces; a vectorised maximum over the lengths picks the best way to arrive and
is stored as a backpointer.

The model at hand merges pairs by rank, so the score of a path is not a sum of piece scores.
It still has a Viterbi form.  A sequence of pieces is what merging by rank yields if and
only if each two neighbours, merged on their own, stay the same two pieces.  The lattice
therefore has transitions of score 0 (neighbours that stay) and minus infinity (neighbours
that would merge), a state is an end position with its best last piece, and the maximum
takes the one piece whose transition is allowed.  The result equals the ids of the library
for the same model.  Whether two neighbours stay is found for whole arrays of pairs by
undoing their merges from the latest on.

Words end before each block of spaces: the loader checks that no piece reaches across.
Characters without a piece become byte pieces.

Defined cases: a null or empty text has no ids and decodes to an empty text; texts may hold
one word of any length (work is linear in it); U+2581 in a text is the space marker itself
and comes back as a space, as in the library; repeated rows are coded alike; an empty table
gives an empty result; a null id stays null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.wordtable import WordTable, memory_returned, ranges, runs

MARK = "▁"
_BASE = np.uint64(0x5851F42D4C957F2D)
_NONE = -1
#: Cells of one lattice matrix (words x lengths), to bound memory.
_CELLS = 1 << 18
#: Words a worker keeps, and bytes of the texts it codes at a time.
WORDS_KEPT, CODED_BYTES = 300_000, 1 << 20
_SLOTS = 1 << 20


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(_SLOTS - 1)).astype(np.int64)


class Model:
    """Pieces of a model file as sorted hash keys, merge ranks and the split of each piece."""

    def __init__(self, data: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain):
            raise ValueError("a piece of this model reaches across words")
        self.unknown = sp.unk_id()
        self.bytes_at = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(len(names[i]) for i in plain)
        self.rank = np.full(n, np.iinfo(np.int64).max, np.int64)
        order = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.full(n, _NONE, np.int64), np.full(n, _NONE, np.int64)
        hashes = self._hash_names([names[i] for i in plain])
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        place = np.argsort(hashes)
        self.keys, self.ids = hashes[place], np.array(plain, np.int64)[place]
        # most keys have a slot of their own in a small hashed table; the few that share one are searched for
        self.place = np.full(_SLOTS, _NONE, np.int32)
        self.place[_slot(self.keys)] = np.arange(len(self.keys))
        pushed = self.place[_slot(self.keys)] != np.arange(len(self.keys))
        self.pushed_keys, self.pushed_ids = self.keys[pushed], self.ids[pushed]
        self.chars = np.zeros(n, np.int64)
        self.chars[plain] = [len(names[i]) for i in plain]
        self.hash_of, self.power_of = np.zeros(n, np.uint64), np.ones(n, np.uint64)
        self.hash_of[plain] = hashes
        self.power_of[plain] = _powers(self.longest)[self.chars[plain]]
        by_name = {names[i]: i for i in plain}
        for i in order:
            self.left[i], self.right[i] = self._last_merge(names[i], by_name)
        # text of each id for decoding; the space marker is a space there
        raw = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)])[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def _hash_names(names: list[str]) -> np.ndarray:
        out = np.zeros(len(names), np.uint64)
        codes = [np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.uint64) for x in names]
        for k, c in enumerate(codes):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in c:
                    h = h * _BASE + x + np.uint64(1)
            out[k] = h
        return out

    def _last_merge(self, name: str, by_name: dict[str, int]) -> tuple[int, int]:
        """The two pieces that merging by rank joins last in this piece (_NONE if it never arises)."""
        parts, before = list(name), None
        while len(parts) > 1:
            found = [(self.rank[j], k) for k in range(len(parts) - 1) if (j := by_name.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return _NONE, _NONE
            k = min(found)[1]
            before = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return by_name.get(before[0], _NONE), by_name.get(before[1], _NONE)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, _NONE for others."""
        flat = np.ravel(hashes)
        out = np.full(len(flat), _NONE, np.int64)
        # most substrings are no pieces, which an empty slot tells of nearly all of them
        at = self.place[_slot(flat)]
        maybe = np.flatnonzero(at >= 0)
        at, wanted = at[maybe], flat[maybe]
        named = self.keys[at] == wanted
        out[maybe[named]] = self.ids[at[named]]
        if len(self.pushed_keys):
            maybe, wanted = maybe[~named], wanted[~named]
            at = np.minimum(np.searchsorted(self.pushed_keys, wanted), len(self.pushed_keys) - 1)
            out[maybe] = np.where(self.pushed_keys[at] == wanted, self.pushed_ids[at], _NONE)
        return out.reshape(hashes.shape)

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours a, b remain when merged on their own.

        Seen backwards, the piece merged last falls apart first.  While the two facing parts
        are a, b they could merge with the rank of the joined piece; that must not come
        before the merge which made the facing part disappear (the `limit`).  The merge that
        would lie further left wins among equal ranks.
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a != _NONE) & (b != _NONE) & (a != self.unknown) & (b != self.unknown))
        x, y = a[live].copy(), b[live].copy()
        none = np.iinfo(np.int64).max
        limit = np.full(len(live), none, np.int64)
        left_limit = np.zeros(len(live), bool)  # the limiting merge lies left of the border
        while len(live):
            joined = self.find(self.hash_of[x] * self.power_of[y] + self.hash_of[y])
            rank = np.where(joined == _NONE, none, self.rank[np.maximum(joined, 0)])
            # equal rank: the border merge comes first unless the limiting one lies further left
            early = (rank < limit) | ((rank == limit) & (rank != none) & ~left_limit)
            ok[live[early]] = False
            rx = np.where(self.left[x] == _NONE, -1, self.rank[x])
            ry = np.where(self.left[y] == _NONE, -1, self.rank[y])
            more = ~early & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            # of equal ranks the right one was merged last
            take_left = rx > ry
            limit = np.where(take_left, rx, ry)
            left_limit = take_left
            x, y = np.where(take_left, self.right[x], x), np.where(take_left, y, self.left[y])
        return ok

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of equal length, end to end, and their borders: `codes` holds a word's code points in each row."""
        rows, length = codes.shape
        power = _powers(self.longest)
        prefix = np.zeros((rows, length + 1), np.uint64)
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i] + np.uint64(1)
        last = np.full((rows, length + 1), self.unknown, np.int64)  # best last piece at each end
        back = np.zeros((rows, length + 1), np.int64)  # its length
        reached = np.zeros((rows, length + 1), bool)
        reached[:, 0] = True
        for end in range(1, length + 1):
            most = min(self.longest, end)
            starts = end - np.arange(1, most + 1)
            piece = self.find(prefix[:, [end]] - prefix[:, starts] * power[1 : most + 1])
            piece[:, 0] = np.where(piece[:, 0] == _NONE, self.unknown, piece[:, 0])
            usable = (piece != _NONE) & reached[:, starts] & ((self.left[piece] != _NONE) | (np.arange(most) == 0))
            r, k = np.nonzero(usable)
            first = starts[k] == 0
            allowed = np.ones(len(r), bool)
            allowed[~first] = self.stays(last[r[~first], starts[k[~first]]], piece[r[~first], k[~first]])
            score = np.full(usable.shape, -np.inf)
            score[r[allowed], k[allowed]] = 0.0
            best = score.argmax(axis=1)
            at = np.arange(rows)
            reached[:, end] = score[at, best] == 0.0
            last[:, end], back[:, end] = piece[at, best], best + 1
        position = np.full(rows, length)
        ids, owner = [], []
        while (open_rows := np.flatnonzero(position > 0)).size:
            ids.append(last[open_rows, position[open_rows]])
            owner.append(open_rows)
            position[open_rows] -= back[open_rows, position[open_rows]]
        flat, owner = np.concatenate(ids)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(owner, kind="stable")
        return flat[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


@lru_cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)), dtype=np.uint64)


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class Coder:
    """Encodes texts word by word and decodes ids."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.table = WordTable(self._encode_words, np.int32, WORDS_KEPT)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """New words, those of equal length together."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        for length, places in by_length.items():
            step = max(1, _CELLS // (length * 8))
            for i in range(0, len(places), step):
                part = places[i : i + step]
                codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                flat, ends = self.model.viterbi(codes.astype(np.uint64))
                odd = np.add.reduceat(flat == self.model.unknown, ends[:-1]) > 0
                borders = ends.tolist()
                for j, k in enumerate(part):
                    ids = flat[borders[j] : borders[j + 1]]
                    out[k] = self._with_bytes(words[k], ids) if odd[j] else ids
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def _with_bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        """Byte pieces in place of unknown characters."""
        out, at = [], 0
        for i in ids.tolist():
            if i == self.model.unknown:
                out += [self.model.bytes_at[b] for b in word[at].encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
            at += 1 if i == self.model.unknown else self.model.chars[i]
        return np.array(out, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return self.table.lookup(pa.array(chain.from_iterable(words), pa.string(), size=int(sizes.sum())), sizes)

    def decode(self, ids: np.ndarray) -> str:
        m = self.model
        raw = ranges(m.raw, m.raw_at[ids], m.raw_len[ids]).tobytes().decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


@lru_cache(maxsize=1)
def coder_of(data: bytes) -> Coder:
    """One coder a worker: its tables outlast a task."""
    return Coder(data)


def coded(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, decoded text, exact (the decoded text is the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            coder = coder_of(model)
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                # only the texts of a part become Python's
                for part in runs(sizes, CODED_BYTES):
                    texts = batch.column(1)[part].to_pylist()
                    ids = coder.encode(texts)
                    decoded = [coder.decode(i) for i in ids]
                    exact = [d == (t or "") for d, t in zip(decoded, texts, strict=True)]
                    made = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(exact, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[part], *made], ["doc_id", "ids", "text", "exact"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string, exact boolean")


def coded_report(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit), text_sha256 of the decoded text, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<u4"), batch.column(1).offsets.to_numpy()
            ends = ends - ends[0]
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), *batch.columns[2:]], ["doc_id", "n_tokens", "ids_crc32", "text", "exact"])

    out = coded(df, model, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text string, exact boolean")
    return out.select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "exact")
