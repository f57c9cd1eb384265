"""Language identification by a linear-chain conditional random field over words.

Every word has a label, so a text may switch languages.  A word of more than PIECE bytes, as in
texts without ASCII spaces, is cut into consecutive pieces, each of them a word with a label.  Emission scores sum learned weights
of hashed features: the word itself (lexicon), prefixes and suffixes, and character n-grams.
Transition scores are learned too, from passages of different languages joined at random
places.  Forward-backward gives the expected number of words of each language; the
document's language is the one with the most, its score that share.

Learning takes at most PASSAGES passages of PASSAGE_WORDS words per language, from documents
chosen by a hash of their id; both are parameters.  A passage of more than PASSAGE_CHARS
characters, as of unspaced words, is cut to so many at a hashed place.  Labelling covers whole texts.  Documents
of about PART_CHARS characters advance together, longest first; each distinct word of theirs is scored once.
Words are ranges of bytes all along: numpy finds their borders and hashes their features, Arrow finds equal ones.

Defined cases: a null text or one without a letter is `und` with score 0; texts of any length
are labelled whole; ties go to the smaller language name; without any labelled document all
is `und`; repeated rows get the same label; rows with a null language are labelled, but not
learnt from; an empty table gives an empty result; other columns are not read by
`languages` and pass through `in_known_language`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import held_out, stage, text_of, words_of
from ledgerspark.llm.wordtable import memory_returned, ranges, runs

PASSAGES, PASSAGE_WORDS, PASSAGE_CHARS, SEED, STEPS = 400, 80, 3200, 11, 60
DIMENSIONS = 1 << 16
#: Rows whose texts are Python objects at a time.
LABELLED_ROWS = 2000
#: Characters of the texts that advance together (or one longer text), and the most words whose features are held at a time.
PART_CHARS, SCORED_WORDS = 1 << 20, 8192
#: The most bytes of a word; longer ones are cut between characters.
PIECE = 40
UNKNOWN = "und"
#: ASCII characters that are no letters, other than spaces, are not part of words.
_DROPPED = bytes(c for c in range(128) if not chr(c).isalpha() and c not in b" \t\n\x0b\x0c\r")


_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: What a byte does to a CRC-32.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_CRC ^= _CRC[0]


def _cleaned(text: str | None) -> bytes:
    """Lower-cased, without ASCII punctuation and digits."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DROPPED)


def _borders(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a cleaned text; pieces of a long word follow each other without a gap."""
    spaces = np.concatenate([[True], _IS_SPACE[np.frombuffer(data, np.uint8)], [True]])
    starts, ends = np.flatnonzero(spaces[:-1] & ~spaces[1:]), np.flatnonzero(~spaces[:-1] & spaces[1:])
    cuts = []
    for w in np.flatnonzero(ends - starts > PIECE).tolist():
        at, last = int(starts[w]), int(ends[w])
        while last - at > PIECE:
            at += PIECE
            while data[at] & 0xC0 == 0x80:
                at -= 1
            cuts.append(at)
    return (np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))) if cuts else (starts, ends)


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation and digits, long ones in pieces."""
    data = _cleaned(text)
    starts, ends = _borders(data)
    return [data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def _hashed(state: np.ndarray | int, data: np.ndarray) -> np.ndarray:
    """CRC-32 states after one more byte each."""
    return _CRC[(state ^ data) & 0xFF] ^ (state >> 8)


def feature_ids(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, end to end, and how many each has: word, affixes of one to four bytes, n-grams of two and three with borders.

    A feature is hashed by CRC-32, with a first byte that tells words, prefixes, suffixes and n-grams apart.
    """
    affixes = np.minimum(lengths, 4)
    sizes = 2 + 2 * affixes + 2 * lengths
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    none = np.uint32(0xFFFFFFFF)
    word, prefix, suffix = (_hashed(none, np.uint8(c)) for c in b"wps")

    order = np.argsort(-lengths, kind="stable")  # those that have a byte at a step are the first ones
    first = starts[order]
    states = np.full(len(lengths), word)
    for t, n in enumerate(np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right").tolist()):
        states[:n] = _hashed(states[:n], data[first[:n] + t])
    out[at[order]] = states
    for k in range(1, 5):
        own = np.flatnonzero(lengths >= k)
        heads, tails = np.full(len(own), prefix), np.full(len(own), suffix)
        for t in range(k):
            heads = _hashed(heads, data[starts[own] + t])
            tails = _hashed(tails, data[starts[own] + lengths[own] - k + t])
        out[at[own] + 2 * k - 1], out[at[own] + 2 * k] = heads, tails

    edges = lengths + 2
    begin = np.cumsum(edges) - edges
    edged = np.empty(int(edges.sum()), np.uint8)
    inner = np.ones(len(edged), bool)
    inner[begin] = inner[begin + edges - 1] = False
    edged[begin], edged[begin + edges - 1], edged[inner] = ord("^"), ord("$"), ranges(data, starts, lengths)
    two = _hashed(_hashed(none, edged[:-1]), edged[1:])
    three = _hashed(two[:-1], edged[2:])
    grams = at + 1 + 2 * affixes
    for found, from_, count in ((two, grams, lengths + 1), (three, grams + lengths + 1, lengths)):
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(from_, count) + place] = found[np.repeat(begin, count) + place]
    return (out ^ none) % DIMENSIONS, sizes


def _listed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of the words of an array of large binaries."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), ends[:-1], np.diff(ends)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def forward_backward(emit: np.ndarray, start: np.ndarray, move: np.ndarray, lengths: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of all words, expected transitions summed over sequences; zeros unless `moves`).

    `emit` holds positive factors, words of sequence after sequence; sequences come longest
    first, so those still running at a step are a prefix.
    """
    labels = emit.shape[1]
    moved = np.zeros((labels, labels))
    if not len(lengths):
        return np.empty_like(emit), moved
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    # words of one step lie side by side from here on
    ends = np.cumsum(running)
    steps = list(zip((ends - running).tolist(), ends.tolist(), running.tolist(), strict=True))
    step = np.repeat(np.arange(len(running)), running)
    order = (np.cumsum(lengths) - lengths)[np.arange(len(emit)) - (ends - running)[step]] + step
    emit = emit[order]
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    before = None
    for i, j, n in steps:
        here = emit[i:j] * (start if before is None else before[:n] @ move)
        before = np.divide(here, here.sum(axis=-1, keepdims=True), out=alpha[i:j])
    after = np.ones((len(lengths), labels))
    for t in range(len(steps) - 1, -1, -1):
        i, j, n = steps[t]
        beta[i:j] = after[:n]
        onward = emit[i:j] * after[:n]
        if moves and t:
            prior = alpha[steps[t - 1][0] : steps[t - 1][0] + n]
            pair = prior[:, :, None] * move * onward[:, None, :]
            moved += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        here = onward @ move.T
        np.divide(here, here.sum(axis=-1, keepdims=True), out=after[:n])
    gamma = np.empty_like(emit)
    gamma[order] = _normal(alpha * beta)
    return gamma, moved


class Crf:
    """Weights of features, transitions and starts for sorted language names."""

    def __init__(self, names: list[str]):
        self.names = names
        k = len(names)
        self.weights = np.zeros((DIMENSIONS + 1, k))  # the last row pads
        self.move, self.start = np.zeros((k, k)), np.zeros(k)

    def fit(self, sequences: list[list[bytes]], labels: list[np.ndarray], steps: int = STEPS, rate: float = 0.1, penalty: float = 1e-4) -> Crf:
        """Adam on the mean log-likelihood of all sequences."""
        order = sorted(range(len(sequences)), key=lambda i: (-len(sequences[i]), i))
        sequences, labels = [sequences[i] for i in order], [labels[i] for i in order]
        lengths = np.array([len(s) for s in sequences])
        known = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        types = np.array([known[w] for s in sequences for w in s])
        flat, sizes = feature_ids(*_listed(pa.array(list(known), pa.large_binary())))
        width = int(sizes.max())
        used = np.full((len(known), width), DIMENSIONS)
        used[np.arange(width) < sizes[:, None]] = flat
        y = np.concatenate(labels)
        k, total = len(self.names), len(y)
        truth = np.zeros((total, k))
        truth[np.arange(total), y] = 1
        at = np.cumsum(lengths) - lengths
        inner = np.ones(total, bool)
        inner[at] = False
        seen_moves = np.zeros((k, k))
        np.add.at(seen_moves, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
        seen_starts = np.bincount(y[at], minlength=k)
        params = [self.weights, self.move, self.start]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            scores = self.weights[used].sum(axis=1)
            emit = np.exp(scores - scores.max(axis=1, keepdims=True))[types]
            gamma, moved = forward_backward(emit, np.exp(self.start), np.exp(self.move), lengths)
            per_type = np.column_stack([np.bincount(types, (truth - gamma)[:, j], len(known)) for j in range(k)])
            flat = used.ravel()
            slope = np.column_stack([np.bincount(flat, np.repeat(per_type[:, j], width), DIMENSIONS + 1) for j in range(k)])
            slope[DIMENSIONS] = 0
            slopes = [slope / total - penalty * self.weights, (seen_moves - moved) / total, (seen_starts - gamma[at].sum(axis=0)) / total]
            for p, g, m, v in zip(params, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def emissions(self, words: pa.Array) -> np.ndarray:
        """A row of positive factors per word, the largest of them 1."""
        data, starts, lengths = _listed(words)
        out = np.empty((len(words), len(self.names)))
        for i in range(0, len(words), SCORED_WORDS):
            part = slice(i, i + SCORED_WORDS)
            flat, sizes = feature_ids(data, starts[part], lengths[part])
            scores = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes)
            out[part] = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))
        return out


class Labeller:
    """Labels whole texts; a word's emission is found once for all texts that advance together."""

    def __init__(self, model: Crf):
        self.model = model
        self.start, self.move = np.exp(model.start), np.exp(model.move)

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Expected share of each language among the words of each cleaned text; zeros where it has none."""
        joined = b" ".join(texts)
        starts, ends = _borders(joined)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
        out = np.zeros((len(texts), len(self.model.names)))
        order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        lengths = counts[order]
        if not len(order):
            return out
        # words of the texts in that order, as one array without the spaces
        chosen = ranges(np.arange(len(starts)), (np.cumsum(counts) - counts)[order], lengths)
        data = np.frombuffer(joined, np.uint8)
        letters = data[~_IS_SPACE[data]]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        emit = self.model.emissions(coded.dictionary)[coded.indices.to_numpy()[chosen]]
        gamma, _ = forward_backward(emit, self.start, self.move, lengths, moves=False)
        out[order] = np.add.reduceat(gamma, np.cumsum(lengths) - lengths) / lengths[:, None]
        return out

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        # texts of like length together: a step advances all texts of a part
        order = sorted((i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))), key=lambda i: -len(texts[i]))
        for part in runs([len(texts[i]) for i in order], PART_CHARS):
            shares = self.shares([_cleaned(texts[i]) for i in order[part]])
            for i, b, s in zip(order[part], shares.argmax(axis=1).tolist(), shares.max(axis=1).tolist(), strict=True):
                if s:
                    names[i], scores[i] = self.model.names[b], min(1.0, s)
        return names, scores


def passages(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PASSAGES, n_words: int = PASSAGE_WORDS) -> list[tuple[str, list[bytes]]]:
    """At most `per_language` passages of each language, of at most PASSAGE_CHARS characters, from documents that may be learnt from."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), text_of(text_col).alias("_text"))
    rows = rows.where(F.col("_lang").isNotNull() & F.coalesce(~held_out(F.col("_id"), 5, 0), F.lit(True)))
    place = F.row_number().over(W.partitionBy("_lang").orderBy(F.xxhash64("_id", F.lit(SEED)), "_id"))
    drawn = rows.select("_id", "_lang").withColumn("_place", place).where(F.col("_place") <= per_language)
    drawn = stage(drawn.select(F.col("_id").alias("_did"), "_lang").distinct(), "drawn-documents")
    chosen = rows.drop("_lang").join(F.broadcast(drawn), F.col("_id").eqNullSafe(F.col("_did")))
    words = chosen.select("_lang", "_id", words_of(F.col("_text")).alias("_w"))
    first = F.pmod(F.xxhash64("_id"), F.greatest(F.lit(1), F.size("_w") - n_words + 1)).cast("int") + 1
    passage = words.select("_lang", "_id", F.array_join(F.slice("_w", first, n_words), " ").alias("_p"))
    begin = F.pmod(F.xxhash64("_id"), F.greatest(F.lit(1), F.length("_p") - PASSAGE_CHARS + 1)).cast("int") + 1
    found = passage.select("_lang", F.col("_p").substr(begin, F.lit(PASSAGE_CHARS))).collect()
    return [(lang, w) for lang, p in sorted(map(tuple, found)) if (w := word_list(p))]


def learn(found: list[tuple[str, list[bytes]]]) -> Crf | None:
    """A model from passages; a third of the sequences switch language on the way."""
    names = sorted({lang for lang, _ in found})
    if not names:
        return None
    number, pick = {n: i for i, n in enumerate(names)}, np.random.default_rng(SEED)
    sequences, labels = [], []
    for i in pick.permutation(len(found)):
        lang, words = found[i]
        sequence, label = list(words), [number[lang]] * len(words)
        if pick.random() < 1 / 3:
            other, more = found[int(pick.integers(len(found)))]
            cut, cut2 = int(pick.integers(len(sequence) + 1)), int(pick.integers(len(more) + 1))
            sequence, label = sequence[:cut] + more[cut2:], label[:cut] + [number[other]] * (len(more) - cut2)
        if sequence:
            sequences.append(sequence)
            labels.append(np.array(label))
    return Crf(names).fit(sequences, labels)


def _labelled(rows: DataFrame, model: Crf | None, schema: str, text_at: int | None = None) -> DataFrame:
    """Column 0 of `rows` with language and score; the text is column 1, or field `text_at` of a struct in column 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            labeller = Labeller(model) if model else None
            for batch in batches:
                for at in range(0, batch.num_rows, LABELLED_ROWS):
                    first = batch.column(0).slice(at, LABELLED_ROWS)
                    texts = (batch.column(1).slice(at, LABELLED_ROWS) if text_at is None else first.field(text_at)).to_pylist()
                    names, scores = labeller.label(texts) if labeller else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                    yield pa.RecordBatch.from_arrays([first, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [batch.schema.names[0], "lang_pred", "score"])
            del labeller

    return rows.mapInArrow(run, schema)


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.  Rows with crc32(id) % 5 = 0 are never learnt from."""
    model = learn(passages(df, id_col, text_col, lang_col))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    out = _labelled(rows, model, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score")


def in_known_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows with a learned language whose words make up at least `least` of the text, with the columns of `df`."""
    model = learn(passages(df, id_col, text_col, lang_col))
    rows = df.select(F.struct("*").alias("_row"))
    at = [c.lower() for c in df.columns].index(text_col.lower())
    out = _labelled(rows, model, f"_row {df.select(F.struct('*').alias('r')).schema['r'].dataType.simpleString()}, lang_pred string, score double", at)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
