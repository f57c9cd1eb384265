"""Ids of words, each word encoded once while the table has room for it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import compress, repeat

import numpy as np
import pyarrow as pa

#: Words kept; the table starts afresh beyond that, so memory is bounded.
MOST_WORDS = 150_000


def ranges(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all pairs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - ends + lengths, lengths)]


@contextmanager
def memory_returned() -> Iterator[None]:
    """Gives free memory back to the system afterwards: Spark keeps a worker for later tasks."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU C library only
        if trim:
            trim(0)


class WordTable:
    """Looks words up; `encode` gives the ids of new ones, end to end, and how many each has.

    When there is no room for new words, those that were looked up again since the last time stay
    (half the table at most), as they are the ones that come again.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype: type, most: int = MOST_WORDS):
        self.encode, self.dtype, self.most, self.seen = encode, dtype, most, {}
        self._hold({}, np.empty(0, dtype), np.empty(0, np.int64))

    def _hold(self, seen: dict, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.seen, self.flat, self.lengths, self.starts = seen, flat, lengths, np.cumsum(lengths) - lengths
        self.again = np.zeros(len(lengths), bool)

    def _make_room(self, wanted: list) -> None:
        """Forgets words until `wanted` go in beside the others (all are forgotten if they are too many for that)."""
        stay = np.flatnonzero(self.again)[: self.most // 2]
        names = list(compress(self.seen, self.again.tolist()))[: len(stay)]
        self.seen.clear()  # before the next table is built, so that there are never two
        kept = dict(zip(names, range(len(stay)), strict=True))
        if len(kept) + sum(w not in kept for w in wanted) > self.most:
            kept, stay = {}, stay[:0]
        self._hold(kept, ranges(self.flat, self.starts[stay], self.lengths[stay]), self.lengths[stay])

    def _add(self, words: list) -> None:
        flat, lengths = self.encode(words)
        self.seen.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def _places(self, words: list) -> np.ndarray:
        at = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        self.again[at[at >= 0]] = True
        if (at < 0).any():
            if len(self.seen) + np.count_nonzero(at < 0) > self.most:
                self._make_room(words)
                at = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
            missing = np.flatnonzero(at < 0).tolist()
            if missing:
                self._add(list(dict.fromkeys(words[i] for i in missing)))
                at[missing] = [self.seen[words[i]] for i in missing]
        return at

    def lookup(self, words: pa.Array, sizes: np.ndarray, named: Callable[[pa.Array], list] = pa.Array.to_pylist) -> list[np.ndarray]:
        """Per text the arrays of its words, joined; `sizes`: how many of `words` each text has.

        Equal words are found by Arrow, so that only the distinct ones become Python's; `named` makes keys of the table of these.
        """
        coded = words.dictionary_encode()
        at = self._places(named(coded.dictionary))[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        flat = ranges(self.flat, self.starts[at], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        return [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def runs(sizes: Sequence[int], most: int) -> list[slice]:
    """Consecutive items with at most `most` in sum (or a single larger one)."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            out.append(slice(start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append(slice(start, len(sizes)))
    return out
