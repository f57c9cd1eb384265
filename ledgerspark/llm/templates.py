"""Line deduplication by a tree of line templates.

The tree has a fixed depth: token count, then the first DEPTH tokens.  A token with a digit is
a variable field from the start.  Below a leaf, a token is constant at its position if it
stands there in at least SUPPORT documents; everything else becomes a field, so that lines
which differ in names or numbers share a template.  Templates made mostly of fields say
nothing and are ignored, which says nothing of identical lines.  A template that recurs in at least MIN_DOCS documents with
different texts is boilerplate: its lines are dropped from every document.  A line that recurs
word for word needs no template: it is dropped from every document as soon as a second
different text holds it, whatever its length, its digits and its fields.

Leaves that too few documents reach are left out before any token is looked at, equal lines
are counted once, and only hashes are shuffled until then.  The text travels once, to meet
the line numbers to drop.

Defined cases: null and empty texts have no lines; blank lines are no lines and stay; copies
of a whole text count as one document; repeated rows lose the same lines; ids may be null or
repeat; an empty table gives an empty result; further columns pass through `without_lines`
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stage, text_of, words_of

DEPTH, SUPPORT, MIN_DOCS, LEAST_CONSTANT, LEAST_SHARE = 3, 8, 8, 2, 0.6
FIELD = "<*>"
_WITH_DIGIT = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _masked(line: Column) -> Column:
    return words_of(F.regexp_replace(line, _WITH_DIGIT, FIELD))


def _keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = text_of(text_col)
    return df.select(*more, F.col(id_col).alias("_id"), F.xxhash64(text).alias("_doc"), text.alias("_text"))


def _lines(rows: DataFrame) -> DataFrame:
    """`_id`, `_doc`, `_pos`, `_tokens`, `_same` (hash of the words), `_line` (hash of the tokens), `_leaf` (hash of the path) of each line with a word."""
    lines = rows.select("_id", "_doc", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_raw")).where(F.col("_raw").rlike(r"[^\x20\x09-\x0D]"))
    words = lines.select("_id", "_doc", "_pos", "_raw", words_of(F.col("_raw")).alias("_words"))
    masked = F.when(F.col("_raw").rlike("[0-9]"), _masked(F.col("_raw"))).otherwise(F.col("_words"))
    tokens = words.select("_id", "_doc", "_pos", F.xxhash64("_words").alias("_same"), masked.alias("_tokens"))
    path = F.xxhash64(F.size("_tokens"), F.slice("_tokens", 1, DEPTH))
    return tokens.withColumns({"_line": F.xxhash64("_tokens", F.lit(1)), "_leaf": path})


def recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slim lines `_id`, `_doc`, `_pos`, `_same`, `_line`; hashes `_line` of the templates' lines to drop; hashes `_same` of lines in two texts), all staged."""
    lines = _lines(_keyed(df, id_col, text_col))
    slim = stage(lines.select("_id", "_doc", "_pos", "_same", "_line", "_leaf"), "lines")
    shared = stage(slim.groupBy("_same").agg(F.min("_doc").alias("_a"), F.max("_doc").alias("_b")).where("_a < _b").select("_same"), "shared-lines")
    seen = stage(slim.select("_doc", "_line", "_leaf").distinct(), "document-lines")
    leaves = seen.select("_leaf", "_doc").distinct().groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_DOCS).select("_leaf")
    leaves = stage(leaves, "leaves")
    counts = seen.join(leaves, "_leaf", "left_semi").groupBy("_leaf", "_line").agg(F.count(F.lit(1)).alias("_docs"))
    texts = lines.select("_leaf", "_line", "_tokens").join(leaves, "_leaf", "left_semi").groupBy("_leaf", "_line").agg(F.min("_tokens").alias("_tokens"))
    known = stage(counts.join(texts, ["_leaf", "_line"]), "distinct-lines")

    at = known.select("_leaf", "_line", "_docs", F.posexplode("_tokens").alias("_i", "_token"))
    common = at.groupBy("_leaf", "_i", "_token").agg(F.sum("_docs").alias("_support")).where((F.col("_support") >= SUPPORT) & (F.col("_token") != FIELD))
    marked = at.join(common, ["_leaf", "_i", "_token"], "left").select("_leaf", "_line", "_i", F.when(F.col("_support").isNotNull(), F.col("_token")).otherwise(FIELD).alias("_token"))
    listed = F.array_sort(F.collect_list(F.struct("_i", "_token")))
    shaped = marked.groupBy("_leaf", "_line").agg(F.transform(listed, lambda t: t["_token"]).alias("_shape"), F.count(F.when(F.col("_token") != FIELD, 1)).alias("_fixed"))
    shaped = shaped.where((F.col("_fixed") >= LEAST_CONSTANT) & (F.col("_fixed") >= LEAST_SHARE * F.size("_shape")))
    shaped = stage(shaped.select("_line", F.xxhash64("_leaf", "_shape").alias("_template")), "templates")
    reach = seen.select("_doc", "_line").join(shaped, "_line").select("_template", "_doc").distinct()
    often = reach.groupBy("_template").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_DOCS)
    recurring = stage(shaped.join(often, "_template", "left_semi").select("_line").distinct(), "recurring")
    return slim, recurring, shared


def _cleaned(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows with `_left`, the text without recurring lines, and the numbers of lines and dropped ones."""
    slim, recurring, shared = recurring_lines(df, id_col, text_col)
    drop = slim.join(recurring.withColumn("_by_template", F.lit(True)), "_line", "left").join(shared.withColumn("_by_words", F.lit(True)), "_same", "left")
    drop = drop.where("_by_template or _by_words")
    drop = drop.groupBy(F.col("_id").alias("_i"), F.col("_doc").alias("_d")).agg(F.collect_set("_pos").alias("_drop"))
    rows = _keyed(df, id_col, text_col, *more).join(drop, F.expr("_id <=> _i and _doc = _d"), "left")
    rows = rows.withColumns({"_gone": F.coalesce("_drop", F.array().cast("array<int>")), "_raw": F.split("_text", "\n", -1)})
    left = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(F.filter("_raw", lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    return rows.withColumns({"_left": left, "_lines": F.size(F.filter("_raw", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), "_dropped": F.size("_gone")})


def template_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, chars_left, text_sha256 of what is left."""
    out = _cleaned(df, id_col, text_col)
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"),
        F.length("_left").cast("long").alias("chars_left"), F.sha2(F.col("_left").cast("binary"), 256).alias("text_sha256"),
    )


def without_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with recurring lines taken out of the text; a null text stays null."""
    out = _cleaned(df, id_col, text_col, F.struct("*").alias("_row"))
    columns = [F.when(F.col("_row").getField(c).isNotNull(), F.col("_left")).alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in df.columns]
    return out.select(*columns)
