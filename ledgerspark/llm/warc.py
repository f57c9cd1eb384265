"""WARC archives: written with revisit records, read by verifying the chain of record borders.

Writing: records with equal payloads of at least LEAST_REVISIT bytes share one response, that
of the smallest id; the others are revisits without a payload.  The text sink writes a record
a row, with the record terminator as line separator.

Reading: the text source cuts the archives at the record magic, in byte ranges that tasks read
independently.  A cut may also lie inside a payload that quotes the magic.  So every cut is
only a candidate; from its header follows the offset where its successor must start.  Pointer
jumping from the start of each file (the jump table is joined with itself, doubling the reach
every round) keeps the candidates on the chain.  Segments that are not on it belong to the
payload of the last one that is.

Defined cases: null html is an empty payload; a null id is written as an empty one and comes
back null; of equal payloads a null id is a revisit unless all ids are null; rows that repeat
the smallest id are all responses; control characters and spaces in a URL become %20; an
empty table gives no records; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import best_of_group, new_folder, stage, text_of

#: Fixed values of the format.
MAGIC, BREAK = "WARC/1.0\r\n", "\r\n"
END = BREAK * 2
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_REVISIT, DATE = 100, "2020-01-01T00:00:00Z"


def _revisits(rows: DataFrame) -> DataFrame:
    """(`_rid`, `_rdigest`, `_refers`) of the rows that repeat the payload of a smaller id."""
    slim = stage(rows.where(F.col("_bytes") >= LEAST_REVISIT).select("_id", "_digest"), "payload-digests")
    best = best_of_group(slim, "_digest", "_id", largest=False)
    found = best.where(~F.col("_id").eqNullSafe(F.col("_best")))
    return stage(found.select(F.col("_id").alias("_rid"), F.col("_digest").alias("_rdigest"), F.col("_best").alias("_refers")).distinct(), "revisits")


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of `df` to new archives in `folder`."""
    payload = text_of(html_col)
    rows = df.select(
        F.col(id_col).cast("long").alias("_id"), text_of(url_col).alias("_url"), payload.alias("_payload"), F.octet_length(payload).cast("long").alias("_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("_digest"),
    )
    full = rows.join(_revisits(rows), F.expr("_id <=> _rid and _digest = _rdigest"), "left")
    revisit = F.col("_rdigest").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "_payload"))

    def urn(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    refers = F.concat(F.lit("WARC-Refers-To: "), urn("_refers"), F.lit(f"{BREAK}WARC-Profile: {REVISIT_PROFILE}{BREAK}"))
    full = full.withColumn("_block", block)
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{BREAK}WARC-Record-ID: "), urn("_id"),
        F.lit(f"{BREAK}WARC-Date: {DATE}{BREAK}WARC-Target-URI: "), F.regexp_replace("_url", r"[\x00-\x20\x7F]", "%20"),
        F.lit(f"{BREAK}WARC-Payload-Digest: sha256:"), F.col("_digest"), F.lit(BREAK), F.when(revisit, refers).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{BREAK}Content-Length: "), F.octet_length("_block").cast("string"), F.lit(END), F.col("_block"),
    )
    full.select(record.alias("value")).write.option("lineSep", END).text(folder)


def _field(head: Column, name: str, value: str) -> Column:
    found = F.regexp_extract(head, rf"(?is)(?:^|\r\n){name}: *{value}", 1)
    return F.when(found != "", found)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between two magics, in file order: `_file`, `_range`, `_at`, `_text`."""
    texts = spark.read.option("lineSep", MAGIC).text(folder)
    return texts.select(
        F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("_text"),
    )


def _candidates(segments: DataFrame) -> DataFrame:
    """Staged: each segment's offset (of the magic before it), length, and the offset its header promises next."""
    head = F.substring_index("_text", END, 1)
    size = _field(head, "Content-Length", r"(\d{1,15})").cast("long")
    slim = segments.select("_file", "_range", "_at", F.octet_length("_text").cast("long").alias("_len"), (F.octet_length(head) + size).alias("_promised"))
    slim = stage(slim, "segments")
    ranges = slim.groupBy("_file", "_range").agg(F.sum(F.col("_len") + len(MAGIC)).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_file").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(F.col("_len") + len(MAGIC)).over(W.partitionBy("_file", "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = slim.withColumn("_inside", inside).join(ranges.select("_file", "_range", before.alias("_before")), ["_file", "_range"])
    # the first segment of a file lies before its first magic
    offset = F.col("_before") + F.col("_inside") - len(MAGIC)
    placed = placed.withColumn("_offset", offset).where("_offset >= 0")
    return stage(placed.select("_file", "_at", "_offset", "_len", (F.col("_offset") + len(MAGIC) + F.col("_promised") + 2 * len(END)).alias("_next")), "candidates")


def on_chain(candidates: DataFrame) -> DataFrame:
    """(`_file`, `_offset`) of the candidates that the chain from offset 0 reaches."""
    jumps = candidates.where("_next is not null").select("_file", "_offset", "_next")
    jumps = stage(jumps.join(candidates.select("_file", F.col("_offset").alias("_next")), ["_file", "_next"], "left_semi").select("_file", "_offset", "_next"), "jumps")
    reached, known = stage(candidates.where("_offset = 0").select("_file", "_offset"), "reached"), 0
    while (now := reached.count()) > known:
        known = now
        further = reached.join(jumps, ["_file", "_offset"]).select("_file", F.col("_next").alias("_offset"))
        reached = stage(reached.union(further).distinct(), "reached")
        second = jumps.select("_file", F.col("_offset").alias("_next"), F.col("_next").alias("_far"))
        jumps = stage(jumps.join(second, ["_file", "_next"]).select("_file", "_offset", F.col("_far").alias("_next")), "jumps")
    return reached


def _parsed(rows: DataFrame) -> DataFrame:
    """Whole records (`_text`, ending in the terminator) taken apart."""
    head = F.substring_index("_text", END, 1)
    out = rows.select("_text", head.alias("_head"))
    out = out.select("_head", F.expr(f"substring(_text, length(_head) + {len(END) + 1}, length(_text) - length(_head) - {2 * len(END)})").alias("_block"))
    payload = F.expr(f"substring(_block, length(substring_index(_block, '\\r\\n\\r\\n', 1)) + {len(END) + 1})")
    number = lambda name: _field(F.col("_head"), name, r"<urn:page:(-?\d+)>").cast("long")
    out = out.select(
        number("WARC-Record-ID").alias("_id"), F.lower(_field(F.col("_head"), "WARC-Type", r"(\w+)")).alias("_type"), number("WARC-Refers-To").alias("_refers"),
        F.lower(_field(F.col("_head"), "WARC-Payload-Digest", r"sha256:([0-9a-fA-F]+)")).alias("_declared"), payload.alias("_payload"),
    )
    return out.select(
        "_id", "_type", "_refers", "_declared", F.when(F.col("_type") == "response", F.octet_length("_payload").cast("long")).alias("_bytes"),
        F.when(F.col("_type") == "response", F.sha2(F.col("_payload").cast("binary"), 256)).alias("_digest"),
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are taken from the payload itself; a revisit takes those of the response
    that it refers to and that holds the digest it declares.
    """
    with _same_splits(spark):
        return _read(spark, folder)


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """All scans meanwhile cut the archives alike, whatever cores come or go.

    Segments are named by split and place, and the archives are scanned more than once.
    """
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _read(spark: SparkSession, folder: str) -> DataFrame:
    segments = _segments(spark, folder)
    cut = _candidates(segments)
    chain = on_chain(cut).withColumn("_good", F.lit(True))
    marked = stage(cut.join(chain, ["_file", "_offset"], "left"), "marked")
    # a record is in one piece if it is on the chain and its segment ends where the next record starts
    whole = F.col("_good") & (F.col("_offset") + len(MAGIC) + F.col("_len") == F.col("_next"))
    odd = stage(marked.where(~F.coalesce(whole, F.lit(False))).select("_file", "_offset", "_at", "_good"), "odd-segments")
    plain = segments.join(odd.select("_at"), "_at", "left_anti")
    records = _parsed(plain.where(F.length("_text") > 0).select("_text"))
    if not odd.isEmpty():
        owner = F.last(F.when(F.col("_good"), F.col("_offset")), ignorenulls=True).over(W.partitionBy("_file").orderBy("_offset").rowsBetween(W.unboundedPreceding, 0))
        pieces = odd.withColumn("_owner", owner).where("_owner is not null").join(segments.select("_at", "_text"), "_at")
        joined = pieces.groupBy("_file", "_owner").agg(F.array_sort(F.collect_list(F.struct("_offset", "_text"))).alias("_p"))
        records = records.unionByName(_parsed(joined.select(F.array_join(F.transform("_p", lambda p: p["_text"]), MAGIC).alias("_text"))))
    records = stage(records, "records")
    kept = records.where("_type = 'response'").select(F.col("_id").alias("_rid"), F.col("_digest").alias("_rdigest"), F.col("_bytes").alias("_rbytes")).distinct()
    again = records.where("_type = 'revisit'").join(kept, F.expr("_refers <=> _rid and _declared = _rdigest"), "left")
    again = again.select("_id", "_type", "_refers", F.col("_rbytes").alias("_bytes"), F.col("_rdigest").alias("_digest"))
    both = records.where("_type = 'response'").select("_id", "_type", F.lit(None).cast("long").alias("_refers"), "_bytes", "_digest").unionByName(again)
    return both.select(F.col("_id").alias("page_id"), F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), F.col("_type").alias("record_type"), F.col("_refers").alias("refers_to"))


def warc_round_trip(df: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write `df` as archives, read them back."""
    folder = folder or new_folder(df.sparkSession, "warc")
    write_warc(df, folder, **columns)
    return read_warc(df.sparkSession, folder)
