"""Statement files: ragged multi-section CSV text to raw rows bound to their headers.

A file is one broker statement and is read whole; work is spread over files.
Records of a file stay together after one shuffle of its text, which every later
per-file window reuses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.text import period

BOM = "\ufeff"
# Row types, the line that changes between two exports of one statement.
ROW_TYPES = ["Header", "Data", "SubTotal", "Total", "Notes", ""]
GENERATED_LINE = "Statement,Data,WhenGenerated"
NEWLINE = "\r\n|\r|\n"
FIELD = r',((?:[^,"]++|"[^"]*+(?:""[^"]*+)*+"?)*+)'
QUOTED = r'"([^"]*+(?:""[^"]*+)*+)"?'


def scan(spark: SparkSession, path: str, portfolio: Column | None = None) -> DataFrame:
    """One row per statement file below `path`: portfolio_id, path, text, bytes."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    who = F.lit("default") if portfolio is None else portfolio
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes")
    ).withColumn("portfolio_id", who)


def body(text: Column) -> Column:
    """Text without a byte order mark."""
    return F.when(F.startswith(text, F.lit(BOM)), F.substring(text, 2, 2147483647)).otherwise(text)


def canonical_hash(text: Column) -> Column:
    """Hash that ignores the generation-time line, the byte order mark and line endings."""
    lines = F.filter(F.split(body(text), NEWLINE), lambda s: ~F.startswith(s, F.lit(GENERATED_LINE)))
    return F.sha2(F.array_join(lines, "\n"), 256)


def identify(files: DataFrame) -> DataFrame:
    """Add the two identities of a file.

    `file_id` names one text in one portfolio, so that a statement loaded into two
    portfolios is two files; `canonical_id` is compared within a portfolio.
    """
    whose = F.coalesce(F.col("portfolio_id").cast("string"), F.lit(""))
    return files.withColumns({"file_id": F.sha2(F.concat(whose, F.lit("\x1f"), "text"), 256), "canonical_id": canonical_hash(F.col("text"))})


def records(files: DataFrame) -> DataFrame:
    """(portfolio_id, file_id, line_no, fields): one row per CSV record, ragged and untrimmed.

    A line starts a record when the quotes before it in the file are balanced; lines inside a
    quoted field are joined back with a line feed.  A file is read once, however many rows carry
    its id.  Lines are neither sorted nor grouped: a text is cut into numbered records as it is.
    """
    spread = files.select("portfolio_id", "file_id", "text").repartition("file_id")
    once = spread.groupBy("file_id").agg(F.max("portfolio_id").alias("portfolio_id"), F.first("text", ignorenulls=True).alias("text"))
    numbered = F.transform(F.split(body(F.col("text")), NEWLINE), lambda line, i: F.concat((i + 1).cast("string"), F.lit(":"), line))
    # line feeds are the only line ends by now; those outside quotes become carriage returns
    parts = F.transform(F.split(F.array_join(numbered, "\n"), '"'), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit("\n"), F.lit("\r"))).otherwise(p))
    cut = once.select("portfolio_id", "file_id", F.explode(F.split(F.array_join(parts, '"'), "\r")).alias("line"))
    rest = F.substring(F.col("line"), F.instr("line", ":") + 1, F.lit(2147483647))
    joined = cut.select(
        "portfolio_id", "file_id", F.substring_index("line", ":", 1).cast("int").alias("line_no"),
        F.when(F.contains("line", F.lit("\n")), F.regexp_replace(rest, r"\n\d+:", "\n")).otherwise(rest).alias("record"),
    )
    raw = F.regexp_extract_all(F.concat(F.lit(","), F.col("record")), F.lit(FIELD), F.lit(1))
    fields = F.transform(
        raw, lambda f: F.when(F.contains(f, F.lit('"')), F.replace(F.regexp_replace(f, QUOTED, "$1"), F.lit('""'), F.lit('"'))).otherwise(f)
    )
    return joined.where(F.col("record") != "").select(
        "portfolio_id", "file_id", "line_no", fields.alias("fields")
    )


def bind_headers(rows: DataFrame, **carried: Callable[[Column], Column]) -> DataFrame:
    """Add section, row type and the header in force: a Header row rebinds its section.

    `carried`: further columns, each a function of a header; computed once per Header row.
    """
    kind = F.get("fields", F.lit(1))
    typed = rows.withColumns(
        {
            "section": F.coalesce(F.get("fields", F.lit(0)), F.lit("")), "raw_type": kind,
            "row_type": F.when(kind.isin(*ROW_TYPES), kind).otherwise(F.lit("")),
        }
    )
    names = F.slice("fields", 3, F.greatest(F.size("fields") - 2, F.lit(1)))
    own = F.when(F.col("row_type") == "Header", F.struct(names.alias("header"), *[f(names).alias(n) for n, f in carried.items()]))
    w = W.partitionBy("file_id", "section").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    bound = typed.withColumn("_bound", F.last(own, ignorenulls=True).over(w))
    return bound.withColumns(
        {
            "header": F.coalesce("_bound.header", F.array().cast("array<string>")), **{n: F.col(f"_bound.{n}") for n in carried},
            "first": F.trim(F.coalesce(F.get("fields", F.lit(2)), F.lit(""))),
        }
    ).drop("_bound")


def bound_map(header: Column, fields: Column) -> Column:
    """Lossless header -> cell map: blank names become __colN, repeats get a ` (n)` suffix."""
    named = F.transform(header, lambda h, i: F.when(h == "", F.concat(F.lit("__col"), (i + 2).cast("string"))).otherwise(h))
    extra = F.when(
        F.size(fields) > F.size(header) + 2,
        F.transform(F.sequence(F.size(header) + 2, F.size(fields) - 1), lambda i: F.concat(F.lit("__col"), i.cast("string"))),
    ).otherwise(F.array().cast("array<string>"))
    names = F.concat(named, extra)

    def entry(name, i):
        earlier = F.size(F.filter(F.slice(names, F.lit(1), i), lambda n: n == name))
        key = F.when(earlier == 0, name).otherwise(F.concat(name, F.lit(" ("), (earlier + 1).cast("string"), F.lit(")")))
        return F.struct(key.alias("k"), F.coalesce(F.get(fields, i + 2), F.lit("")).alias("v"))

    return F.map_from_entries(F.transform(names, entry))


def file_headers(rows: DataFrame) -> DataFrame:
    """Account, base currency, title, broker, period and generation time per file (last one wins)."""
    at = lambda name, i: F.coalesce(
        F.when(F.array_position("header", name) > 0, F.coalesce(F.get("fields", (F.array_position("header", name) + 1).cast("int")), F.lit(""))),
        F.get("fields", F.lit(i)), F.lit(""),
    )
    key, value = F.trim(at("Field Name", 2)), F.trim(at("Field Value", 3))
    facts = rows.where((F.col("row_type") == "Data") & F.col("section").isin("Statement", "Account Information")).select(
        "file_id", "line_no", F.concat_ws("/", "section", key).alias("fact"), value.alias("value")
    )
    pick = lambda fact: F.nullif(F.max_by("value", F.when(F.col("fact") == fact, F.col("line_no"))), F.lit(""))
    good = F.col("good")
    heads = facts.withColumn("good", F.when(F.col("fact") == "Statement/Period", period("value"))).groupBy("file_id").agg(
        pick("Statement/BrokerName").alias("broker"), pick("Statement/Title").alias("title"),
        pick("Statement/WhenGenerated").alias("when_generated"), pick("Account Information/Account").alias("account"),
        pick("Account Information/Base Currency").alias("base_currency"),
        F.max_by(good, F.when(good.isNotNull(), F.col("line_no"))).alias("p"),
    )
    counts = rows.groupBy("file_id").agg(
        F.first("portfolio_id").alias("portfolio_id"), F.count(F.lit(1)).alias("row_count"),
        F.array_sort(F.collect_set(F.nullif(F.col("section"), F.lit("")))).alias("sections"),
    )
    return counts.join(heads, "file_id", "left").select(
        "portfolio_id", "file_id", "broker", "title", "account", "base_currency", "when_generated",
        F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), "row_count", "sections",
    )


def structure_warnings(rows: DataFrame) -> DataFrame:
    """Structural complaints, once per kind and file: (file_id, warn_key, line_no)."""
    payload = F.col("row_type").isin("Data", "SubTotal", "Total")
    value = F.trim(F.coalesce(F.get("fields", F.lit(3)), F.lit("")))
    odd_period = (F.col("section") == "Statement") & (F.col("row_type") == "Data") & (F.col("first") == "Period") & (value != "") & period(value).isNull()
    keys = F.array_compact(
        F.array(
            F.when(F.col("raw_type").isNull(), F.concat(F.lit("short|"), "section")),
            F.when(F.col("raw_type").isNotNull() & ~F.col("raw_type").isin(*ROW_TYPES), F.concat_ws("|", F.lit("rowtype"), "section", "raw_type")),
            F.when(payload & (F.size("header") == 0), F.concat(F.lit("orphan|"), "section")),
            F.when(odd_period, F.concat(F.lit("period|"), value)),
        )
    )
    return rows.select("file_id", "line_no", F.explode(keys).alias("warn_key")).groupBy("file_id", "warn_key").agg(F.min("line_no").alias("line_no"))


@dataclass
class Raw:
    """The raw tier of a batch of statements."""

    files: DataFrame
    rows: DataFrame
    warnings: DataFrame


def parse(files: DataFrame, shared: Callable[[DataFrame], DataFrame] = lambda rows: rows, **carried: Callable[[Column], Column]) -> Raw:
    """Raw tables of a batch of files (one row per distinct file content).

    `shared` may store the bound rows, which heads and warnings are read from as well; `carried` is for `bind_headers`.
    """
    known = identify(files)
    named = known.withColumn("bytes", F.octet_length("text")).groupBy("portfolio_id", "file_id").agg(
        F.min("path").alias("path"), F.min_by("canonical_id", "path").alias("canonical_id"), F.min_by("bytes", "path").alias("bytes")
    )
    rows = shared(bind_headers(records(known), **carried))
    heads = file_headers(rows).join(named.select("file_id", "path", "canonical_id", "bytes"), "file_id")
    return Raw(heads, rows, structure_warnings(rows))
