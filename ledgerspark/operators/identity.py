"""Instrument identity inside a statement: reference rows, mentions, resolution, stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.text import asset_bucket, num, to_date, to_datetime
from ledgerspark.operators.sections import DIVIDENDS, cell, is_data_row, trimmed

# Shapes of dividend descriptions and of derivative categories.
DESC_ID = r"^([^(]+)\(([A-Z0-9]{9,12})\)\s*([\s\S]*)$"
PER_SHARE = r"(?i)\b[A-Z]{3}\s+([\d,]+(?:\.\d+)?)\s+per\s+share\b"
TRAILING_PAREN = r"\(([^()]*)\)\s*$"
DERIVATIVE = r"(?i)option|future|warrant|cfd"


def _null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def described(text: Column) -> dict[str, Column]:
    """Symbol, ISIN, per-share rate and type named in a dividend description."""
    t = F.trim(text)
    hit = t.rlike(DESC_ID)
    rest = F.when(hit, F.regexp_extract(t, DESC_ID, 3)).otherwise(text)
    return {
        "d_symbol": F.when(hit, _null_if_blank(F.regexp_extract(t, DESC_ID, 1))),
        "d_isin": F.when(hit, F.regexp_extract(t, DESC_ID, 2)),
        "per_share": num(F.regexp_extract(rest, PER_SHARE, 1)),
        "div_type": _null_if_blank(F.regexp_extract(rest, TRAILING_PAREN, 1)),
    }


def variants(symbol: Column) -> Column:
    """Spellings to look up in order: as written, upper case, without a lowercase venue suffix."""
    bare = F.regexp_replace(symbol, "[a-z]+$", "")
    return F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("p"), symbol.alias("alias")), F.struct(F.lit(1).alias("p"), F.upper(symbol).alias("alias")),
            F.when((F.length(bare) >= 2) & (bare != symbol), F.struct(F.lit(2).alias("p"), bare.alias("alias"))),
        )
    )


def drafts(rows: DataFrame) -> DataFrame:
    """Reference rows per file: aliases with the root ticker first, and the strongest key."""
    src = rows.where((F.col("section") == "Financial Instrument Information") & is_data_row())
    listed = F.filter(F.transform(F.split(cell("symbol"), ","), lambda s: F.trim(s)), lambda s: s != "")
    root = trimmed("underlying")
    ordered = F.when(
        (root != "") & ~trimmed("asset_category").rlike(DERIVATIVE), F.array_distinct(F.concat(F.array(root), listed))
    ).otherwise(listed)
    src = src.select(
        "file_id", "line_no", ordered.alias("aliases"), (F.size(listed) > 0).alias("ok"), _null_if_blank(cell("conid")).alias("conid"),
        _null_if_blank(cell("security_id")).alias("isin"), trimmed("description").alias("name"), trimmed("asset_category").alias("asset_category"),
        _null_if_blank(cell("type")).alias("type"), _null_if_blank(cell("listing_exch")).alias("exchange"),
        F.coalesce(num(cell("multiplier")), F.lit(1.0)).alias("multiplier"),
    ).where("ok")
    first = F.get("aliases", F.lit(0))
    key = F.coalesce("conid", "isin", F.when(F.col("exchange").isNotNull(), F.concat_ws("|", first, "exchange")), first)
    source = F.when(F.col("conid").isNotNull(), "conid").when(F.col("isin").isNotNull(), "isin").when(F.col("exchange").isNotNull(), "symbol+exchange").otherwise("symbol")
    facts = F.struct("conid", "isin", first.alias("symbol"), "name", "asset_category", "type", "exchange", "multiplier", source.alias("identity_source"))
    keyed = src.withColumns({"instrument_key": key, "facts": facts})
    merged = keyed.groupBy("file_id", "instrument_key").agg(
        F.min_by("facts", "line_no").alias("f"), F.min("line_no").alias("draft_order"),
        F.array_sort(F.collect_list(F.struct("line_no", "aliases"))).alias("a"),
    )
    return merged.select("file_id", "instrument_key", "draft_order", "f.*", F.array_distinct(F.flatten(F.transform("a", lambda x: x["aliases"]))).alias("aliases"))


def mentions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that name a security, with symbol, ISIN, date and currencies, ranked by section."""
    paid = F.col("section").isin(*DIVIDENDS, "Withholding Tax")
    rank = (
        F.when(F.col("section") == "Open Positions", 1).when(F.col("section") == "Trades", 2).when(F.col("section") == "Dividends", 3)
        .when(F.col("section") == "Payment In Lieu Of Dividends", 4).when(F.col("section") == "Withholding Tax", 5)
        .when(F.col("section") == "Change in Dividend Accruals", 6).when(F.col("section") == "Transaction Fees", 7)
    )
    src = rows.where(is_data_row() & rank.isNotNull()).withColumns(described(cell("description")))
    disc = trimmed("discriminator")
    kept = (
        ((F.col("section") != "Open Positions") | (disc != "Lot"))
        & ((F.col("section") != "Trades") | ((disc != "ClosedLot") & ~F.lower(asset_bucket(cell("asset_category"))).eqNullSafe("forex") & to_datetime(cell("date_time")).isNotNull()))
        & (~paid | to_date(cell("date")).isNotNull())
    )
    symbol = F.coalesce(_null_if_blank(cell("symbol")), F.when(paid, F.col("d_symbol")))
    ccy = _null_if_blank(cell("currency"))
    seen = src.where(kept).join(files.select("file_id", "period_end"), "file_id").select(
        "file_id", "line_no", rank.alias("rank"), symbol.alias("symbol"), F.when(paid, F.col("d_isin")).alias("d_isin"), F.when(paid, F.col("d_symbol")).alias("d_symbol"),
        trimmed("asset_category").alias("asset_category"),
        F.when(rank == 1, F.col("period_end")).when(rank == 2, to_date(cell("date_time"))).otherwise(to_date(cell("date"))).alias("date"),
        F.when(rank <= 2, ccy).alias("trade_currency"), F.when(rank.isin(3, 4, 6), ccy).alias("div_currency"),
    )
    harvest = seen.where(F.col("d_isin").isNotNull() & F.col("d_symbol").isNotNull()).groupBy("file_id", F.col("d_symbol").alias("symbol")).agg(
        F.min_by("d_isin", F.struct("rank", "line_no")).alias("h_isin")
    )
    out = seen.where(F.col("symbol").isNotNull()).join(harvest, ["file_id", "symbol"], "left")
    return out.withColumn("isin", F.coalesce("d_isin", "h_isin")).drop("h_isin", "d_isin", "d_symbol")


def resolve(mentions_: DataFrame, drafts_: DataFrame) -> DataFrame:
    """(file, symbol, isin) -> instrument key: ISIN first, then an alias that does not contradict it.

    What stays open becomes a stub keyed by ISIN or symbol; spellings of one
    unknown ticker share a stub.
    """
    asked = mentions_.groupBy("file_id", "symbol", "isin").agg((F.min("rank") <= 6).alias("mints"))
    by_isin = drafts_.where(F.col("isin").isNotNull()).groupBy("file_id", "isin").agg(F.min_by("instrument_key", "draft_order").alias("isin_key"))
    spelled = drafts_.select("file_id", "instrument_key", F.col("isin").alias("draft_isin"), "draft_order", F.explode("aliases").alias("raw"))
    spelled = spelled.withColumn("alias", F.explode(F.array_distinct(F.array("raw", F.upper("raw")))))
    by_alias = spelled.groupBy("file_id", "alias").agg(F.min_by(F.struct("instrument_key", "draft_isin"), "draft_order").alias("hit"))
    tried = asked.withColumn("v", F.explode(variants(F.col("symbol")))).select("file_id", "symbol", "isin", "v.p", "v.alias")
    hits = tried.join(by_alias, ["file_id", "alias"]).where(
        F.col("isin").isNull() | F.col("hit.draft_isin").isNull() | (F.col("isin") == F.col("hit.draft_isin"))
    )
    alias_key = hits.groupBy("file_id", "symbol", F.coalesce("isin", F.lit("")).alias("isin0")).agg(F.min_by("hit.instrument_key", "p").alias("alias_key"))
    out = asked.withColumn("isin0", F.coalesce("isin", F.lit(""))).join(by_isin, ["file_id", "isin"], "left").join(alias_key, ["file_id", "symbol", "isin0"], "left")
    out = out.withColumn("found", F.coalesce("isin_key", "alias_key"))
    stub = F.coalesce("isin", "symbol")
    open_ = out.where(F.col("found").isNull() & F.col("mints"))
    base = open_.groupBy("file_id", F.col("symbol").alias("alias")).agg(F.min(stub).alias("base_key"), F.max("isin").alias("base_isin"))
    bare = F.element_at(variants(F.col("symbol")), -1)["alias"]
    shared = open_.select("file_id", "symbol", "isin0", "isin", bare.alias("alias")).join(base, ["file_id", "alias"]).where(
        F.col("isin").isNull() | F.col("base_isin").isNull() | (F.col("isin") == F.col("base_isin"))
    ).select("file_id", "symbol", "isin0", "base_key")
    out = out.join(shared, ["file_id", "symbol", "isin0"], "left")
    key = F.coalesce("found", F.when(F.col("mints"), F.coalesce("base_key", stub)))
    return out.select("file_id", "symbol", "isin0", key.alias("instrument_key"))


def keyed_mentions(mentions_: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mentions with their instrument key, addressable by (file_id, line_no)."""
    tagged = mentions_.withColumn("isin0", F.coalesce("isin", F.lit("")))
    return tagged.join(resolved, ["file_id", "symbol", "isin0"], "left").drop("isin0")


def instruments(keyed: DataFrame, drafts_: DataFrame, files: DataFrame) -> DataFrame:
    """One row per instrument and file, including stubs for securities without a reference row."""
    at = F.struct("rank", "line_no")
    on = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), at))
    used = keyed.where((F.col("rank") <= 6) & F.col("instrument_key").isNotNull()).groupBy("file_id", "instrument_key").agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), on("trade_currency").alias("trade_currency"),
        on("div_currency").alias("div_currency"), on("isin").alias("m_isin"), F.min_by("symbol", at).alias("m_symbol"),
        F.array_sort(F.collect_set("symbol")).alias("m_aliases"), on("asset_category").alias("m_category"),
    )
    both = drafts_.join(used, ["file_id", "instrument_key"], "full_outer").join(
        files.select("file_id", "portfolio_id", "period_start", "period_end"), "file_id"
    )
    empty = F.array().cast("array<string>")
    return both.select(
        "portfolio_id", "file_id", "instrument_key",
        F.coalesce("identity_source", F.when(F.col("m_isin") == F.col("instrument_key"), "isin").otherwise("symbol")).alias("identity_source"),
        "conid", F.coalesce("isin", "m_isin").alias("isin"), F.coalesce("symbol", "m_symbol").alias("symbol"),
        F.array_distinct(F.concat(F.coalesce("aliases", empty), F.coalesce("m_aliases", empty))).alias("aliases"),
        F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.nullif("asset_category", F.lit("")), F.col("m_category"), F.lit("")).alias("asset_category"),
        "type", F.col("exchange").alias("listing_exchange"), F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"), "trade_currency", "div_currency",
        F.coalesce("first_seen", "period_start").alias("first_seen"), F.coalesce("last_seen", "period_end").alias("last_seen"),
    )
