"""Raw statement rows to ledger entities, each with a stable content id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.numeric import exact_sum, round_up6
from ledgerspark.functions.text import KEY_SEP, asset_bucket, canon, num, num0, split_codes, to_date, to_datetime
from ledgerspark.operators import identity
from ledgerspark.operators.sections import CASH_KINDS, DIVIDENDS, cell, is_aggregate_label, is_data_row, natural_key, trimmed, with_ids

# Smallest open accrual balance, agreement and band of a recovered rate.
OPEN_ACCRUAL = 0.005
RATE_AGREEMENT = 0.005
RATE_BAND = (1e-4, 1e4)


@dataclass
class Context:
    """A batch of parsed files with resolved securities; `shared` may store the steps that several others read."""

    files: DataFrame
    rows: DataFrame
    drafts: DataFrame
    keyed: DataFrame
    shared: Callable[[DataFrame], DataFrame]

    def section(self, *names: str) -> DataFrame:
        """Rows of some sections with the instrument key of each row."""
        look = self.keyed.select("file_id", "line_no", "instrument_key", "isin")
        return self.rows.where(F.col("section").isin(*names)).join(look, ["file_id", "line_no"], "left")

    @cached_property
    def instruments(self) -> DataFrame:
        return identity.instruments(self.keyed, self.drafts, self.files)

    @cached_property
    def accruals(self) -> DataFrame:
        return self.shared(accrual_rows(self))

    @cached_property
    def positions(self) -> DataFrame:
        return self.shared(position_rows(self))


def context(files: DataFrame, rows: DataFrame, shared: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Context:
    """Securities of a batch resolved."""
    drafts = shared(identity.drafts(rows))
    seen = shared(identity.mentions(rows, files))
    keyed = shared(identity.keyed_mentions(seen, identity.resolve(seen, drafts)))
    return Context(files, rows, drafts, keyed, shared)


def _row_id():
    return F.concat_ws(":", "file_id", "line_no")


def trade_rows(ctx: Context) -> DataFrame:
    """Fills at the coarsest grain per (asset, currency, symbol): orders hide their executions."""
    disc = trimmed("discriminator")
    src = ctx.section("Trades").where(is_data_row()).withColumns(
        {
            "disc": disc, "bucket": asset_bucket(cell("asset_category")), "currency": trimmed("currency"), "symbol": trimmed("symbol"),
            "ts": to_datetime(cell("date_time")),
        }
    )
    block = W.partitionBy("file_id", "bucket", "currency", "symbol")
    src = src.withColumn("has_order", F.max((F.col("disc") == "Order").cast("int")).over(block))
    src = src.where((F.col("disc") != "ClosedLot") & ((F.col("disc") == "Order") | (F.col("has_order") == 0)))
    return src.withColumns({"forex": F.lower("bucket") == "forex", "key": natural_key(F.col("instrument_key"), "Trades")})


def trade_warnings(ctx: Context) -> DataFrame:
    bad_time = trade_rows(ctx).where(F.col("ts").isNull()).select("file_id", F.lit("trade_time").alias("warn_key"), "line_no")
    lots = ctx.rows.where((F.col("section") == "Trades") & is_data_row() & (trimmed("discriminator") == "ClosedLot"))
    lots = lots.select("file_id", F.lit("closed_lots").alias("warn_key"), "line_no")
    return bad_time.unionByName(lots)


def transactions(ctx: Context) -> DataFrame:
    rows = with_ids(trade_rows(ctx).where(F.col("ts").isNotNull() & ~F.col("forex") & (F.col("symbol") != "")))
    q = num0(cell("quantity"))
    return rows.select(
        "portfolio_id", "file_id", "line_no", "id", _row_id().alias("row_id"), "instrument_key", F.when(q >= 0, "BUY").otherwise("SELL").alias("kind"),
        "ts", F.col("ts").cast("date").alias("date"), q.alias("quantity"), num0(cell("price")).alias("price"), "currency", num0(cell("proceeds")).alias("proceeds"),
        F.abs(num0(cell("commission"))).alias("fees"), num0(cell("basis")).alias("basis"), num0(cell("realized")).alias("realized_pnl"),
        split_codes(cell("code")).alias("codes"), "bucket",
    )


_CASH = ["portfolio_id", "file_id", "line_no", "row_id", "section", "key", "kind", "date", "amount", "currency", "description"]


def _forex_legs(ctx: Context) -> DataFrame:
    rows = trade_rows(ctx).where(F.col("ts").isNotNull() & F.col("forex"))
    fee = F.abs(num0(cell("commission")))
    text = F.concat_ws(" ", "symbol", num0(cell("quantity")).cast("string"), F.lit("@"), num0(cell("price")).cast("string"))
    legs = F.array_compact(
        F.array(
            F.struct(F.lit("fx").alias("tag"), F.lit("FX").alias("kind"), num0(cell("proceeds")).alias("amount"), text.alias("description")),
            F.when(fee != 0, F.struct(F.lit("fxfee").alias("tag"), F.lit("FEE").alias("kind"), (-fee).alias("amount"), F.concat(F.lit("Commission on "), text).alias("description"))),
        )
    )
    out = rows.withColumn("leg", F.explode(legs))
    return out.select(
        "portfolio_id", "file_id", "line_no", _row_id().alias("row_id"), "section", F.concat_ws(KEY_SEP, "key", "leg.tag").alias("key"), "leg.kind",
        F.col("ts").cast("date").alias("date"), "leg.amount", "currency", "leg.description",
    )


def _plain_cash(ctx: Context) -> DataFrame:
    rows = ctx.section(*CASH_KINDS).where(is_data_row()).withColumns({"amount": num0(cell("amount")), "date": to_date(cell("date"))})
    fixed = F.create_map(*[F.lit(x) for s, k in CASH_KINDS.items() if k for x in (s, k)])
    kind = F.coalesce(fixed[F.col("section")], F.when(F.col("amount") >= 0, "DEPOSIT").otherwise("WITHDRAWAL"))
    return rows.where(F.col("date").isNotNull()).select(
        "portfolio_id", "file_id", "line_no", _row_id().alias("row_id"), "section", natural_key(F.col("instrument_key"), *CASH_KINDS).alias("key"), kind.alias("kind"),
        "date", "amount", trimmed("currency").alias("currency"), cell("description").alias("description"),
    )


def _payment_rows(ctx: Context, *sections: str) -> DataFrame:
    rows = ctx.section(*sections).where(is_data_row()).withColumns(identity.described(cell("description")))
    rows = rows.withColumns({"date": to_date(cell("date")), "currency": trimmed("currency"), "amount": num0(cell("amount")), "description": cell("description")})
    symbol = F.coalesce(F.nullif(trimmed("symbol"), F.lit("")), F.col("d_symbol"), F.lit(""))
    return rows.where(F.col("date").isNotNull()).withColumns(
        {"who": F.coalesce("instrument_key", symbol), "key": natural_key(F.col("instrument_key"), *sections), "order": F.struct("section", "line_no")}
    )


def pair_withholding(dividends: DataFrame, taxes: DataFrame) -> DataFrame:
    """(file_id, tax_line, line_no): the dividend each withholding line belongs to.

    A lone dividend takes all lines of its (instrument, day, currency).  Several
    are paired by equal per-share rate first, the rest in order.
    """
    slot = ["file_id", "who", "date", "currency"]
    d = dividends.select(*slot, "line_no", "order", "per_share").withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*slot)))
    t = taxes.select(*slot, F.col("line_no").alias("tax_line"), "per_share")
    lone = t.join(d.where(F.col("n") == 1).select(*slot, "line_no"), slot).select(*slot, "tax_line", "line_no")
    many = d.where(F.col("n") > 1)
    by_rate = W.partitionBy(*slot, "per_share")
    rated_d = many.where(F.col("per_share").isNotNull()).withColumn("k", F.row_number().over(by_rate.orderBy("order"))).select(*slot, "per_share", "k", "line_no")
    rated_t = t.where(F.col("per_share").isNotNull()).withColumn("k", F.row_number().over(by_rate.orderBy("tax_line"))).select(*slot, "per_share", "k", "tax_line")
    rated = rated_t.join(rated_d, [*slot, "per_share", "k"]).select(*slot, "tax_line", "line_no")
    by_slot = W.partitionBy(*slot)
    left_d = many.join(rated.select("file_id", "line_no"), ["file_id", "line_no"], "left_anti")
    left_d = left_d.withColumn("k", F.row_number().over(by_slot.orderBy("order"))).select(*slot, "k", "line_no")
    left_t = t.join(rated.select("file_id", "tax_line"), ["file_id", "tax_line"], "left_anti")
    left_t = left_t.withColumn("k", F.row_number().over(by_slot.orderBy("tax_line"))).select(*slot, "k", "tax_line")
    rest = left_t.join(left_d, [*slot, "k"]).select(*slot, "tax_line", "line_no")
    return lone.unionByName(rated).unionByName(rest).select("file_id", "tax_line", "line_no")


def accrual_rows(ctx: Context) -> DataFrame:
    """Accrual postings and reversals with the content id of each row."""
    rows = ctx.section("Change in Dividend Accruals").where(is_data_row() & (trimmed("symbol") != ""))
    rows = with_ids(rows.withColumn("key", natural_key(F.col("instrument_key"), "Change in Dividend Accruals")))
    return rows.select(
        "portfolio_id", "file_id", "line_no", "id", _row_id().alias("row_id"), "instrument_key", trimmed("currency").alias("currency"),
        to_date(cell("ex_date")).alias("ex_date"), to_date(cell("pay_date")).alias("pay_date"), num0(canon(cell("gross_rate"))).alias("gross_rate"),
        canon(cell("gross_rate")).alias("rate_text"), num0(cell("quantity")).alias("quantity"), num0(cell("tax")).alias("tax"),
        num0(cell("gross_amount")).alias("gross"), num0(cell("net_amount")).alias("net"), trimmed("code").alias("codes"),
    )


def net_accruals(rows: DataFrame, within: list[str]) -> DataFrame:
    """Postings net of reversals per payment; the rate is not part of the payment's identity."""
    at = F.struct("file_id", "line_no")
    posted = F.struct((~F.col("codes").rlike(r"\bPo\b")).alias("not_po"), "file_id", "line_no")
    agg = rows.groupBy(*within, "instrument_key", "ex_date", "pay_date", "currency").agg(
        F.min_by("quantity", posted).alias("quantity"), F.min_by("gross_rate", at).alias("gross_rate"), F.min_by("rate_text", at).alias("rate_text"),
        round_up6(exact_sum("gross")).alias("gross"), round_up6(exact_sum("tax")).alias("tax"), exact_sum("net").alias("net0"),
        F.count(F.lit(1)).alias("postings"),
    )
    text = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))
    key = F.concat_ws(KEY_SEP, F.lit("accrual"), "instrument_key", text("ex_date"), text("pay_date"), "rate_text", "currency")
    return agg.withColumns(
        {
            "net": round_up6(F.col("net0")), "open": F.abs("net0") > OPEN_ACCRUAL,
            "id": F.substring(F.sha2(F.concat(key, F.lit("\u001e0")), 256), 1, 20),
        }
    ).drop("net0", "rate_text")


def distributions(ctx: Context) -> tuple[DataFrame, DataFrame]:
    """(distributions, cash events for withholding without a dividend)."""
    facts = ["portfolio_id", "file_id", "line_no", "section", "instrument_key", "isin", "d_isin", "who", "date", "currency", "amount", "per_share", "description", "div_type", "order", "key"]
    divs = ctx.shared(with_ids(_payment_rows(ctx, *DIVIDENDS)).select(*facts, "id"))
    taxes = ctx.shared(_payment_rows(ctx, "Withholding Tax").select(*facts))
    pairs = ctx.shared(pair_withholding(divs, taxes))
    matched = taxes.select("file_id", F.col("line_no").alias("tax_line"), F.col("amount").alias("tax_amount")).join(pairs, ["file_id", "tax_line"])
    tax = matched.groupBy("file_id", "line_no").agg(exact_sum("tax_amount").alias("withheld"), F.array_sort(F.collect_list("tax_line")).alias("tax_lines"))
    nets = net_accruals(ctx.accruals, ["portfolio_id", "file_id"]).select(
        "file_id", "instrument_key", F.col("pay_date").alias("date"), F.col("ex_date").alias("a_ex"), F.col("gross_rate").alias("a_rate")
    )
    rated = F.abs(F.col("a_rate") - F.col("per_share")) < 1e-9
    ex = divs.select("file_id", "line_no", "instrument_key", "date", "per_share").join(nets, ["file_id", "instrument_key", "date"]).groupBy("file_id", "line_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rated).alias("n_rated"), F.collect_set("a_ex").alias("all_ex"),
        F.collect_set(F.when(rated, F.col("a_ex"))).alias("rated_ex"),
    )
    picked = F.when((F.col("n") > 1) & (F.col("n_rated") > 0), F.col("rated_ex")).otherwise(F.col("all_ex"))
    rows = divs.join(tax, ["file_id", "line_no"], "left").join(ex, ["file_id", "line_no"], "left")
    withheld = F.coalesce(-F.col("withheld"), F.lit(0.0))
    out = rows.select(
        "portfolio_id", "file_id", "line_no", "section", "id", _row_id().alias("row_id"), "instrument_key", F.coalesce("d_isin", "isin").alias("isin"),
        F.col("date").alias("pay_date"), F.when(F.size(picked) == 1, F.get(picked, F.lit(0))).alias("ex_date"), "currency",
        F.col("amount").alias("gross"), round_up6(withheld).alias("tax"), round_up6(F.col("amount") - withheld).alias("net"), "per_share", "description", "div_type", "tax_lines",
    )
    alone = taxes.join(pairs.select("file_id", F.col("tax_line").alias("line_no")), ["file_id", "line_no"], "left_anti")
    alone = alone.select("portfolio_id", "file_id", "line_no", _row_id().alias("row_id"), "section", "key", F.lit("TAX").alias("kind"), "date", "amount", "currency", "description")
    return out, alone


def cash_events(ctx: Context, lone_tax: DataFrame) -> DataFrame:
    """Currency legs, unmatched withholding and plain cash lines under one id scheme."""
    legs = _forex_legs(ctx).select(*_CASH).unionByName(lone_tax.select(*_CASH)).unionByName(_plain_cash(ctx).select(*_CASH))
    return with_ids(legs).drop("key", "ordinal")


def position_rows(ctx: Context) -> DataFrame:
    """Open Positions in file order: data rows, totals, and the block each belongs to."""
    rows = ctx.section("Open Positions").where(F.col("row_type") != "Header")
    total = F.col("row_type").isin("Total", "SubTotal") | is_aggregate_label()
    fact = ~total & (F.col("row_type") == "Data") & (trimmed("discriminator") != "Lot") & (trimmed("symbol") != "")
    rows = rows.withColumns(
        {
            "is_total": total, "is_fact": fact, "currency": trimmed("currency"), "value": num(cell("value")), "cost": num(cell("cost_basis")),
        }
    )
    w = W.partitionBy("file_id").orderBy("line_no")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "facts": F.count_if("is_fact").over(upto),
            "block_currency": F.last(F.when(F.col("is_fact"), F.col("currency")), ignorenulls=True).over(upto),
        }
    )
    fits = F.col("is_total") & (F.col("facts") > 0) & F.col("currency").isin("") | (F.col("is_total") & (F.col("facts") > 0) & (F.col("currency") == F.col("block_currency")))
    earlier = F.count_if(fits).over(W.partitionBy("file_id", "facts").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    # a total closes the block above it unless an earlier total already did
    rows = rows.withColumn("block_open", F.col("is_total") & (F.col("facts") > 0) & (F.coalesce(earlier, F.lit(0)) == 0))
    rows = rows.withColumn("closes", F.col("block_open") & fits)
    return rows.withColumn("block", F.count_if("closes").over(w.rowsBetween(W.unboundedPreceding, -1)))


def positions(ctx: Context) -> DataFrame:
    rows = ctx.positions.where("is_fact").join(ctx.files.select("file_id", "account", "period_end"), "file_id")
    return rows.select(
        "portfolio_id", "file_id", "line_no", F.coalesce("account", F.lit("")).alias("account"), F.col("period_end").alias("as_of"), "instrument_key", "currency",
        num0(cell("quantity")).alias("quantity"), num0(cell("cost_price")).alias("cost_price"), F.coalesce("cost", F.lit(0.0)).alias("cost_basis"),
        num0(cell("close_price")).alias("close_price"), F.coalesce("value", F.lit(0.0)).alias("value"), num0(cell("unrealized")).alias("unrealized_pnl"),
        asset_bucket(cell("asset_category")).alias("bucket"),
    )


def recovered_rates(ctx: Context) -> DataFrame:
    """Rates a statement states about itself: a block total followed by itself in base currency."""
    totals = ctx.positions.where("is_total").join(ctx.files.select("file_id", "base_currency", "period_end"), "file_id")
    w = W.partitionBy("file_id").orderBy("line_no")
    prev = lambda c: F.lag(F.when(F.col("block_open"), F.col(c))).over(w)
    rows = totals.withColumns({"p_ccy": prev("block_currency"), "p_cost": prev("cost"), "p_value": prev("value")})
    x = F.when(F.abs("p_cost") >= 1e-6, F.col("cost") / F.col("p_cost"))
    y = F.when(F.abs("p_value") >= 1e-6, F.col("value") / F.col("p_value"))
    r = (x + y) / 2
    good = (x > 0) & (y > 0) & (F.abs(x - y) / x <= RATE_AGREEMENT) & r.between(*RATE_BAND)
    rows = rows.where((F.col("currency") == F.col("base_currency")) & (F.col("p_ccy") != F.col("base_currency")) & good & F.col("period_end").isNotNull())
    return rows.select("portfolio_id", "file_id", F.col("base_currency").alias("base"), F.col("p_ccy").alias("quote"), F.col("period_end").alias("date"), (1.0 / r).alias("rate"))
