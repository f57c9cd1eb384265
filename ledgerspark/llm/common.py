"""What several operators share: text rules, staged tables, the best row of each group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Counters of the frequent-key summary, and the most keys it may name.
COUNTERS, MOST_HOT = 8192, 1000


def text_of(column: str | Column) -> Column:
    """The text, empty when null."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is (plain lower() is the same on ASCII texts, and faster)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    `batch_rows`: rows of an Arrow batch while this is written, for rows that hold much.
    """
    spark, path, setting = df.sparkSession, new_folder(df.sparkSession, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    try:
        if batch_rows:
            spark.conf.set(setting, batch_rows)
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, usual)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def frequent(df: DataFrame, key: str) -> DataFrame:
    """Hashes (`_h`) of the keys that may be frequent.

    approx_top_k is a Misra-Gries summary: a fixed number of counters, lowered together
    whenever they run out, one summary per task and the summaries merged.  A key with more
    than about a thousandth of the rows keeps its counter, so none is missed; others may be
    named too, and the counts are estimates, which is why callers verify both.  At most
    MOST_HOT rows whatever the input.
    """
    top = df.select(F.xxhash64(key).alias("_h")).select(F.expr(f"approx_top_k(_h, {MOST_HOT}, {COUNTERS})").alias("_top"))
    return top.select(F.explode("_top").alias("_top")).select(F.col("_top.item").alias("_h")).distinct()


def hot_groups(df: DataFrame, key: str, rank: str, largest: bool = True) -> DataFrame:
    """Frequent keys with their exact row count and best rank: (key, `_best`, `_size`), staged; at most MOST_HOT rows.

    Counts are taken over all rows of the named keys with map-side partial aggregation.
    """
    best = F.max(rank) if largest else F.min(rank)
    named = df.withColumn("_h", F.xxhash64(key)).join(F.broadcast(frequent(df, key)), "_h", "left_semi")
    counted = named.groupBy(key).agg(best.alias("_best"), F.count(F.lit(1)).alias("_size"))
    return stage(counted.where("_size > 1"), "hot-groups")


def best_of_group(df: DataFrame, key: str, rank: str, largest: bool = True) -> DataFrame:
    """Each row of the staged table `df` with `_best` (best rank of its key) and `_size` (rows of its key).

    Frequent keys get both from a broadcast of at most MOST_HOT rows and are not shuffled;
    every other key owns a small share of the rows, so a window by key is even.
    """
    hot = F.broadcast(hot_groups(df, key, rank, largest))
    by = W.partitionBy(key)
    best = F.max(rank) if largest else F.min(rank)
    rest = df.join(hot, key, "left_anti").withColumns({"_best": best.over(by), "_size": F.count(F.lit(1)).over(by)})
    return df.join(hot, key).select(*rest.columns).unionByName(rest)
