"""Quality scores by Bradley-Terry pairwise ranking.

Every document has a vector of text features.  A pair of a good and a bad document says that
the first is preferred; the model is a linear score whose difference, through the logistic
function, gives the probability of the preference.  It is fitted by Newton steps on the
logistic loss of feature differences.  Documents are then judged by a quantile of the
learning scores: the share of bad ones among all labelled documents that may be learnt from.  Scores are shifted so that this
quantile is 0.7 on the scale from 0 to 1.

Learning takes every labelled row that may be learnt from: scaling, pairs and the quantile are
added up over all of them in tasks.  Each row of the commoner label is paired with one of the
other by rank, or with several until there are PAIRS pairs; all good with all bad ones would be
quadratic.  The driver holds sums only.

Defined cases: null and empty texts have their own feature and get a score like any other
text; rows without a label, or with a null one, only get scores; with one label or none the
score is 0.5 everywhere; repeated rows get the same score; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import held_out, stage

PAIRS, CUT, BINS = 40_000, 0.7, 4096
_SYMBOLS = b"#*$%&|<>"
_MARKS = b".,;:!?"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
FEATURES = (
    "empty", "log_words", "word_length", "long_words", "short_words", "upper", "digits", "symbols", "pipes", "exclaims", "marks", "non_ascii", "distinct",
    "repeats_next", "distinct_lines", "line_words", "capital_words", "mark_ends",
)


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def features(text: str | None) -> list[float]:
    """The vector of a whole text; shares are of characters or of words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    size = len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(w[-1] in _MARKS for w in words)
    capital = sum(w[:1].isupper() for w in words)
    upper, symbols = _count(raw, _UPPER), _count(raw, _SYMBOLS)
    return [
        0.0, np.log1p(n), lengths.mean() / 10, (lengths > 12).mean(), (lengths <= 3).mean(), upper / size, _count(raw, _DIGITS) / size, symbols / size,
        raw.count(b"|") / n, raw.count(b"!") / n, _count(raw, _MARKS) / n, 1 - len(text) / size, len(set(words)) / n,
        same / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)), capital / n, marked / n,
    ]


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def expanded(x: np.ndarray) -> np.ndarray:
    """Features and their square roots, which spread shares near zero."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


def _task_sums(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str) -> np.ndarray | None:
    """Sum over all rows of what `f` makes of a block of vectors; one row a task reaches the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                part = f(np.array(b[column].tolist(), float))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"_s": [total]})

    got = rows.select(column).mapInPandas(sums, "_s array<double>").collect()
    return np.sum([r["_s"] for r in got], axis=0) if got else None


def scaling(learnt: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the expanded features (`_x`) over all rows."""
    head = _task_sums(learnt, lambda x: np.append(expanded(x).sum(axis=0), len(x)), "_x")
    mean, n = head[:-1] / head[-1], head[-1]
    scale = np.sqrt(_task_sums(learnt, lambda x: ((expanded(x) - mean) ** 2).sum(axis=0), "_x") / n)
    scale[scale < 1e-9] = 1.0
    return mean, scale


def ranked(learnt: DataFrame) -> DataFrame:
    """`_label`, `_x` and `_rank` from 0 within the label, in the order of a hash of `_id`; no label is sorted in one task."""
    rows = learnt.withColumn("_slice", F.shiftright(F.xxhash64("_id"), 52))
    sizes = rows.groupBy("_label", "_slice").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 a label
    before = sizes.select("_label", "_slice", (F.sum("_n").over(W.partitionBy("_label").orderBy("_slice")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_label", "_slice").orderBy(F.xxhash64("_id"), "_id", "_x")) - 1
    return rows.withColumn("_place", place).join(F.broadcast(before), ["_label", "_slice"]).select("_label", "_x", (F.col("_before") + F.col("_place")).alias("_rank"))


def pair_differences(learnt: DataFrame, counts: dict[int, int], mean: np.ndarray, scale: np.ndarray, pairs: int) -> tuple[DataFrame, int]:
    """(`_d`: scaled good less scaled bad vector, number of pairs).  Every row is in a pair.

    Each row of the commoner label meets one of the other label, by rank; several ones where
    that makes fewer than `pairs` pairs.
    """
    more = 1 if counts[1] >= counts[0] else 0
    n_more, n_less = counts[more], counts[1 - more]
    rounds = min(n_less, -(-pairs // n_more))
    rows = stage(ranked(learnt), "ranked")
    shifts = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    many = rows.where(F.col("_label") == more).select(F.col("_x").alias("_a"), "_rank", shifts.alias("_shift"))
    many = many.select("_a", F.pmod(F.col("_rank") + F.col("_shift"), F.lit(n_less)).alias("_to"))
    few = rows.where(F.col("_label") == 1 - more).select(F.col("_x").alias("_b"), F.col("_rank").alias("_to"))
    sign = 1.0 if more == 1 else -1.0

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                one, other = (np.clip((expanded(np.array(b[c].tolist(), float)) - mean) / scale, -8, 8) for c in ("_a", "_b"))
                yield pd.DataFrame({"_d": list(sign * (one - other))})

    return stage(many.join(few, "_to").select("_a", "_b").mapInPandas(differences, "_d array<double>"), "pairs"), n_more * rounds


def fit(learnt: DataFrame, counts: dict[int, int], pairs: int = PAIRS, penalty: float = 1.0) -> dict:
    """Weights and scaling; each Newton step adds up over all pairs.  Together the pairs weigh as `pairs`, whatever their number."""
    mean, scale = scaling(learnt)
    diffs, made = pair_differences(learnt, counts, mean, scale, pairs)
    w, share = np.zeros(len(mean)), pairs / made
    for _ in range(25):

        def slopes(d: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            return np.concatenate([d.T @ (1 - p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        total = _task_sums(diffs, slopes, "_d") * share
        gradient = total[: len(w)] - penalty * w
        step = np.linalg.solve(total[len(w) :].reshape(len(w), -1) + penalty * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "w": w}


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((expanded(x) - model["mean"]) / model["scale"], -8, 8) @ model["w"]


def at_rank(rows: DataFrame, column: str, rank: int) -> float:
    """The value of this rank (from 1) over all rows, exactly: counts in bins, then in the bins of the bin that holds it."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    x = F.col(column)
    while lo < hi and (hi - lo) / BINS > 0:
        place = F.least(F.lit(BINS - 1), F.floor((x - F.lit(lo)) / F.lit((hi - lo) / BINS))).alias("_bin")
        found = rows.where(x.between(lo, hi)).groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).orderBy("_bin").collect()
        for r in found:
            if rank <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo


def scored(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((raw_scores(model, x) - model["cut"]) / model["spread"] + np.log(CUT / (1 - CUT)), -40, 40)))


def learn(labelled: DataFrame, sample: int | None = None, pairs: int = PAIRS) -> dict | None:
    """`labelled`: `_id`, `_x`, `_label`.  Scaling, weights and the cut come from all rows; with `sample`, weights from that many of each label."""
    counts = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    learnt, used = labelled, counts
    if sample is not None:
        place = F.row_number().over(W.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id"))
        learnt = stage(labelled.withColumn("_place", place).where(F.col("_place") <= sample).drop("_place"), "label-sample")
        used = {label: min(n, sample) for label, n in counts.items()}
    model = fit(learnt, used, pairs)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"_raw": raw_scores(model, np.array(b["_x"].tolist(), float))})

    raw = stage(labelled.select("_x").mapInPandas(scores, "_raw double"), "learning-scores")
    model["cut"] = (at_rank(raw, "_raw", counts[0]) + at_rank(raw, "_raw", counts[0] + 1)) / 2
    model["spread"] = float(max(raw.agg(F.stddev_pop("_raw")).first()[0], 1e-6)) / 4
    return model


def quality_scores(df: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.  Rows with crc32(id) % 4 = 2 are never learnt from."""
    kind = dict(df.dtypes)[id_col]

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_x": list(_matrix(b["_text"]))})

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = stage(rows.mapInPandas(vectors, f"_id {kind}, _x array<double>"), "features")  # texts are read once and never travel
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_lid")).agg(F.min(label_col).cast("int").alias("_label"))
    known = known.where(~held_out(F.col("_lid"), 4, 2))
    model = learn(stage(rows.join(known, F.col("_id") == F.col("_lid")).select("_id", "_x", "_label"), "labelled"), sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full(len(b), 0.5) if model is None or not len(b) else scored(model, np.array(b["_x"].tolist(), float))
            yield pd.DataFrame({"doc_id": b["_id"], "score": out})

    out = rows.mapInPandas(score, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
