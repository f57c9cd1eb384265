"""Quality rules: base counts and the divergence of a document from its language.

Each document is described by two histograms: of character classes, and of its language's
most frequent words (all other words together in one more bin).  The references are the same
histograms summed over all texts of the language.  A document fails if the Jensen-Shannon
distance (base 2, so from 0 to 1) of either histogram to its reference is too large.  Short
texts have noisy histograms, so each comparison has a least length, below which it passes.

Three steps: count every word of every text per language (partial sums);
measure every whole text in one map; sum the measures per language and compare.  No text is
shuffled.  Three-word windows are compared by 64-bit hashes of their words.

Defined cases: a null or empty text has no words, all counts are 0 and it fails the base
rules; a null language is compared with the reference over all texts; repeated rows are
judged alike; ties among common words go to the smaller word; an empty table gives an empty
result; further columns are not read by `quality_report` and pass through `good_quality`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import GAP, stage, text_of, words_of

#: Character classes other than spaces and lower-case letters, as regular expressions; what
#: none of these takes is one more class.
CLASSES = (r"\p{Lu}", r"\p{N}", r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]", r"[#*$%&|<>]", r"[\p{Lo}\p{Lt}\p{Lm}]")
SYMBOL_CLASS = 3
PLAIN = r"[\p{Ll}\x20\x09-\x0D]+"
#: Common words: so many bins of most frequent words, whatever their length; the rest is one more bin.
COMMON = 16
#: (least length, largest distance): in characters for classes, in words for common words.
CLASS_RULE, WORD_RULE = (300, 0.3), (50, 0.4)
N_CLASSES = len(CLASSES) + 3


def _entropy(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, rounded to nine places."""
    middle = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    divergence = _entropy(middle) - (_entropy(p) + _entropy(q)) / 2
    return F.round(F.sqrt(F.greatest(divergence, F.lit(0.0))), 9)


def common_words(rows: DataFrame) -> DataFrame:
    """(`_of`, `_common`): the most frequent words of each language; `_of` null: of all texts."""
    words = rows.select("_lang", F.explode(F.split("_text", GAP, -1)).alias("_word")).where("_word != ''")
    counts = stage(words.groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_k")), "word-counts")
    every = counts.groupBy("_word").agg(F.sum("_k").alias("_k")).select(F.lit(None).cast("string").alias("_lang"), "_word", "_k")
    counts = counts.where("_lang is not null").unionByName(every)
    place = F.row_number().over(W.partitionBy("_lang").orderBy(F.desc("_k"), "_word"))
    top = counts.withColumn("_place", place).where(F.col("_place") <= COMMON)
    listed = F.array_sort(F.collect_list(F.struct("_place", "_word")))
    return stage(top.groupBy(F.col("_lang").alias("_of")).agg(F.transform(listed, lambda t: t["_word"]).alias("_common")), "common-words")


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows, in text order."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    hashed = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, hashed).otherwise(F.array().cast("array<bigint>"))


def _sorted_if_repeated(windows: Column) -> Column:
    """Sorted (hash, position), or nothing if all windows differ."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _positions(pairs: Column) -> Column:
    """Sorted positions of the windows that occur twice or more."""
    same = lambda w, i: F.coalesce(F.get(pairs, i)["h"] == w["h"], F.lit(False))
    found = F.filter(pairs, lambda w, i: same(w, i - 1) | same(w, i + 1))
    return F.sort_array(F.transform(found, lambda w: w["i"]))


def _covered(positions: Column) -> Column:
    """Words in the union of the three-word windows at these positions."""
    return F.aggregate(
        positions, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"],
    )


def measured(rows: DataFrame, common: DataFrame) -> DataFrame:
    """`rows` (`_lang`, `_text` and more) with the base figures, class counts and bin counts.

    Columns that a lambda reads are made a projection earlier and read more than once, so
    that the optimizer doesn't move their expression into the lambda.
    """
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = rows.join(common, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    out = out.withColumns({"_w": words_of(t), "_lines": lines, "_odd": F.regexp_replace(t, PLAIN, "")})
    places = F.filter(F.transform("_w", lambda w: F.array_position(F.col("_common"), w)), lambda i: i > 0)
    out = out.withColumns({"_win": _windows(F.col("_w")), "_hits": places, "_inside": F.length(F.array_join("_w", ""))})
    out = out.withColumns({"_pairs": _sorted_if_repeated(F.col("_win"))} | {f"_c{i}": F.regexp_count("_odd", F.lit(c)) for i, c in enumerate(CLASSES)})
    out = out.withColumn("_pos", _positions(F.col("_pairs")))
    times = lambda v: F.size(F.filter("_hits", lambda i: i == v))
    known = sum((F.col(f"_c{i}") for i in range(1, len(CLASSES))), F.col("_c0"))
    n = len(CLASSES)
    return out.select(
        *rows.columns, "_common", *[times(v).alias(f"_b{v}") for v in range(1, COMMON + 1)], F.length(t).alias("_chars"), *[f"_c{i}" for i in range(n)],
        (F.length("_odd") - known).alias(f"_c{n}"), (F.length(t) - F.col("_inside")).alias(f"_c{n + 1}"),
        (F.col("_inside") - F.length("_odd")).alias(f"_c{n + 2}"),
        F.size("_w").cast("long").alias("n_words"), F.col("_inside").cast("long").alias("word_chars"), F.col(f"_c{SYMBOL_CLASS}").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), _covered(F.col("_pos")).alias("n_repeat_words"),
    )


def _class_shares() -> Column:
    return F.array(*[F.col(f"_c{i}") / F.greatest(F.col("_chars"), F.lit(1)) for i in range(N_CLASSES)])


def _word_shares() -> Column:
    n = F.greatest(F.col("n_words"), F.lit(1))
    found = [F.col(f"_b{v}") for v in range(1, COMMON + 1)]
    return F.array(*[c / n for c in found], (F.col("n_words") - sum(found[1:], found[0])) / n)


def references(measures: DataFrame) -> DataFrame:
    """(`_ref`, `_words`, `_classes`) from all measured rows; `_ref` null: over all texts.

    The bins of a language are its own common words, so the row over all texts sums the rows
    without a language, and has only classes when there are none.
    """
    classes, bins = ["_chars", *[f"_c{i}" for i in range(N_CLASSES)]], ["n_words", *[f"_b{v}" for v in range(1, COMMON + 1)]]
    sums = stage(measures.groupBy("_lang").agg(*[F.sum(c).alias(c) for c in classes + bins]), "reference-sums")
    no_lang = [F.sum(F.when(F.col("_lang").isNull(), F.col(c))).alias(c) for c in bins]
    every = sums.agg(*[F.sum(c).alias(c) for c in classes], *no_lang).withColumn("_lang", F.lit(None).cast("string"))
    both = sums.where("_lang is not null").unionByName(every)
    return stage(both.select(F.col("_lang").alias("_ref"), _word_shares().alias("_words"), _class_shares().alias("_classes")), "references")


def judged(measures: DataFrame, refs: DataFrame) -> DataFrame:
    """Measured rows with both distances, base_failed and kept."""
    out = measures.join(refs, F.col("_lang").eqNullSafe(F.col("_ref")), "left")
    out = out.withColumns({"_mine": _word_shares(), "_my_classes": _class_shares()})
    out = out.withColumns({"class_distance": distance(F.col("_my_classes"), F.col("_classes")), "word_distance": distance(F.col("_mine"), F.col("_words"))})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = (F.col("_chars") >= CLASS_RULE[0]) & (F.col("class_distance") > CLASS_RULE[1])
    odd = odd | ((F.col("n_words") >= WORD_RULE[0]) & (F.col("word_distance") > WORD_RULE[1]))
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~odd})


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def _rows(df: DataFrame, lang_col: str, text_col: str, *more: Column) -> DataFrame:
    return df.select(*more, F.col(lang_col).alias("_lang"), text_of(text_col).alias("_text"))


def quality_report(df: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the base figures, base_failed, kept and both distances."""
    rows = _rows(df, lang_col, text_col, F.col(id_col).alias("doc_id"))
    measures = stage(measured(rows, common_words(rows)).drop("_text", "_common"), "measures")
    return judged(measures, references(measures)).select("doc_id", *REPORT)


def good_quality(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns of `df`; measures each text twice rather than shuffle it."""
    rows = _rows(df, lang_col, text_col)
    common = common_words(rows)
    refs = references(measured(rows, common))
    return judged(measured(_rows(df, lang_col, text_col, F.struct("*").alias("_row")), common), refs).where("kept").select("_row.*")
