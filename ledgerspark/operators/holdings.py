"""Holdings: quantity, price, value and gains per position, and portfolio totals.

Unknown stays NULL: a missing price or rate never turns into a zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.numeric import exact_sum, finite, is_zero, pct, sum_known
from ledgerspark.operators import fx
from ledgerspark.operators.lots import LEDGER, ORDER, Ledger, quantity_as_of, replay
from ledgerspark.operators.scan import cut_lineage, small_side

QTY_TOLERANCE = 1e-6


def latest_positions(positions: DataFrame) -> DataFrame:
    """Latest snapshot per account and instrument, added up over accounts."""
    facts = F.struct("as_of", "quantity", finite("close_price").alias("close_price"), "currency", "cost_basis")
    per_account = positions.groupBy(*LEDGER, "account").agg(F.max_by(facts, "as_of").alias("s"))
    closed = F.when(F.col("s.close_price").isNotNull(), F.col("account"))
    return per_account.groupBy(*LEDGER).agg(
        F.max("s.as_of").alias("as_of"), exact_sum("s.quantity").alias("quantity"),
        F.min_by("s.close_price", closed).alias("close_price"), F.min_by("s.currency", "account").alias("currency"),
        exact_sum("s.cost_basis").alias("cost_basis"),
    )


def valuation_dates(transactions: DataFrame, positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Freshest date per portfolio over quotes, snapshots and trades."""
    legs = [
        transactions.select("portfolio_id", F.col("date").alias("d")),
        positions.select("portfolio_id", F.col("as_of").alias("d")),
        quotes.select("portfolio_id", F.to_date("as_of").alias("d")),
    ]
    seen = legs[0].unionByName(legs[1]).unionByName(legs[2])
    return seen.groupBy("portfolio_id").agg(
        F.coalesce(F.max("d"), F.lit("1970-01-01").cast("date")).alias("valued_on")
    )


def _cost_legs(ledger: Ledger, bases: DataFrame, rates: fx.RateTable) -> DataFrame:
    """Open lots in base currency, each at its acquisition date."""
    lots = ledger.rows.where((F.col("seg") > 0) & F.col("sale").isNull()).select(*LEDGER, "currency", F.col("lot.date").alias("lot_date"), F.col("seg_cost").alias("cost"))
    lots = fx.convert(lots.join(bases, "portfolio_id"), {"leg": "cost"}, "currency", "base_currency", "lot_date", rates)
    return lots.groupBy(*LEDGER).agg(
        exact_sum("leg").alias("lots_base"), F.bool_or(F.col("leg").isNull()).alias("lots_gap"),
    )


def _sale_leg(s: Column) -> Column:
    """Gain of sale `s` in base currency, from its `fifo` cost, that in base (`parts`), `gap` and `sale_rate`."""
    proceeds = (s["qty"] * s["unit"] - s["fee"]) * F.col("sale_rate")
    taken = F.when(F.col("method") == "FIFO", F.col("fifo")).otherwise(s["avg_taken"])
    cost = (
        F.when((F.col("fifo") == 0) & (taken == 0), F.lit(0.0))
        .when(F.col("fifo") == 0, taken * F.col("sale_rate"))
        .when(~F.col("gap"), F.col("parts") * (taken / F.col("fifo")))
    )
    return proceeds - cost


def _realized_legs(ledger: Ledger, bases: DataFrame, rates: fx.RateTable) -> DataFrame:
    """Sale proceeds at the sale date less consumed lots at their own dates."""
    used = F.col("seg") > 0
    rows = ledger.rows.where(F.col("sale").isNotNull()).join(bases, "portfolio_id")
    rows = fx.with_rate(rows, "currency", "base_currency", F.col("lot.date"), rates, rate="lot_rate")
    sale = rows.groupBy(*LEDGER, F.col("sale.id").alias("sale_id")).agg(
        F.first("sale").alias("s"), F.first("currency").alias("currency"),
        F.first("base_currency").alias("base_currency"), F.first("method").alias("method"),
        F.coalesce(exact_sum(F.when(used, F.col("seg_cost"))), F.lit(0.0)).alias("fifo"),
        exact_sum(F.when(used, F.col("seg_cost") * F.col("lot_rate"))).alias("parts"),
        F.bool_or(used & F.col("lot_rate").isNull()).alias("gap"),
    )
    sale = fx.with_rate(sale, "currency", "base_currency", F.col("s.date"), rates, rate="sale_rate")
    leg = sale.select(*LEDGER, _sale_leg(F.col("s")).alias("leg"))
    return leg.groupBy(*LEDGER).agg(
        exact_sum("leg").alias("sales_base"), F.bool_or(F.col("leg").isNull()).alias("sales_gap"),
    )


def _summary_and_legs(ledger: Ledger, bases: DataFrame, rates: fx.RateTable) -> DataFrame:
    """The summary with the two kinds of legs, added up while each ledger is replayed: nothing is stored or shuffled again."""
    used, sold = F.col("seg") > 0, F.col("sale").isNotNull()
    rows = fx.with_rate(ledger.rows.join(bases, "portfolio_id", "left"), "currency", "base_currency", F.col("lot.date"), rates, rate="lot_rate")
    rows = fx.with_rate(rows, "currency", "base_currency", F.col("sale.date"), rates, rate="sale_rate")
    # of sales with one id the last counts
    order = W.partitionBy(*LEDGER, sold, F.col("sale.id")).orderBy(*[F.col(c).desc() for c in ("spot", *ORDER)])
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns(
        {
            "head": sold & (F.row_number().over(order) == 1),
            "fifo": F.coalesce(exact_sum(F.when(used, F.col("seg_cost")), over=whole), F.lit(0.0)),
            "parts": exact_sum(F.when(used, F.col("seg_cost") * F.col("lot_rate")), over=whole),
            "gap": F.bool_or(used & F.col("lot_rate").isNull()).over(whole),
        }
    )
    open_lot, lot_leg, sale_leg = used & ~sold, finite("seg_cost") * F.col("lot_rate"), _sale_leg(F.col("sale"))
    # a ledger without an instrument is never looked up
    known = F.col("instrument_key").isNotNull()
    return Ledger(rows).summary(
        lots_base=exact_sum(F.when(known & open_lot, lot_leg)), lots_gap=F.bool_or(F.when(known & open_lot, lot_leg.isNull())),
        sales_base=exact_sum(F.when(known & F.col("head"), sale_leg)), sales_gap=F.bool_or(F.when(known & F.col("head"), sale_leg.isNull())),
    )


def _priced(row_currency: Column) -> Column:
    """Manual price, else quote, else statement close; NULL when none is usable."""
    manual = F.when(
        finite("manual_price").isNotNull(),
        F.struct(
            F.col("manual_price").cast("double").alias("price"),
            F.coalesce("manual_price_currency", row_currency).alias("currency"),
            F.lit("manual").alias("source"), F.col("valued_on").cast("timestamp_ntz").alias("as_of"),
        ),
    )
    quote = F.when(
        finite("quote_price").isNotNull(),
        F.struct(
            F.col("quote_price").alias("price"), F.col("quote_currency").alias("currency"),
            F.lit("quote").alias("source"), F.col("quote_as_of").cast("timestamp_ntz").alias("as_of"),
        ),
    )
    close = F.when(
        F.col("snap_close").isNotNull(),
        F.struct(
            F.col("snap_close").alias("price"), F.col("snap_currency").alias("currency"),
            F.lit("snapshot").alias("source"), F.col("snap_as_of").cast("timestamp_ntz").alias("as_of"),
        ),
    )
    return F.coalesce(manual, quote, close)


def build(
    transactions: DataFrame,
    positions: DataFrame,
    instruments: DataFrame,
    quotes: DataFrame,
    overrides: DataFrame,
    settings: DataFrame,
    rates: fx.RateTable,
    *,
    as_of: str | None = None,
    quantity_source: str = "auto",
    tolerance: float = QTY_TOLERANCE,
    ledger: Ledger | None = None,
) -> DataFrame:
    """One row per (portfolio, instrument) seen in the ledger or in a snapshot."""
    # broadcast where small, so that the replayed rows stay with their ledger
    bases = small_side(settings.select("portfolio_id", "base_currency", F.col("cost_basis_method").alias("method")))
    done = ledger or replay(transactions)
    if done.apart and bases.groupBy("portfolio_id").count().where("count > 1").isEmpty():
        led = cut_lineage(_summary_and_legs(done, bases, rates))
    else:
        # the summary, the open lots and the sales all read the replayed rows
        done = ledger or Ledger(cut_lineage(done.for_holdings().rows))
        led = done.summary().join(_cost_legs(done, bases, rates), LEDGER, "left").join(_realized_legs(done, bases, rates), LEDGER, "left")
    led = led.withColumn("in_ledger", F.lit(True)).withColumnRenamed("quantity", "ledger_quantity").withColumnRenamed("currency", "ledger_currency")
    snap = latest_positions(positions)
    checks = quantity_as_of(transactions, snap.select(*LEDGER, "as_of")).select(
        *LEDGER, F.col("ledger_quantity").alias("ledger_at")
    )
    snap = snap.select(
        *LEDGER, F.col("as_of").alias("snap_as_of"), F.col("quantity").alias("snap_quantity"),
        F.col("close_price").alias("snap_close"), F.col("currency").alias("snap_currency"),
        F.col("cost_basis").alias("snap_cost"),
    )
    inst = instruments.select(
        *LEDGER, "symbol", "name", "asset_category", "aliases", "trade_currency", "div_currency",
        finite("multiplier").alias("multiplier"), F.lit(True).alias("has_instrument"),
    )
    quo = quotes.select(
        *LEDGER, F.col("price").alias("quote_price"), F.col("currency").alias("quote_currency"),
        F.col("as_of").alias("quote_as_of"), F.col("source").alias("quote_source"),
    )
    ovr = overrides.select(*LEDGER, "display_symbol", "manual_price", "manual_price_currency", F.col("excluded").alias("_excluded"))
    if as_of:
        dates = bases.select("portfolio_id", F.lit(as_of).cast("date").alias("valued_on"))
    else:
        dates = valuation_dates(transactions, positions, quotes)

    rows = (
        led.join(snap, LEDGER, "full_outer")
        .join(checks, LEDGER, "left").join(inst, LEDGER, "left").join(quo, LEDGER, "left").join(ovr, LEDGER, "left")
        .join(bases, "portfolio_id").join(dates, "portfolio_id", "left")
    )
    known = F.coalesce(F.col("in_ledger"), F.lit(False))
    has_snap = F.col("snap_as_of").isNotNull()
    from_snap = {"snapshot": has_snap, "auto": has_snap & ~known, "ledger": F.lit(False)}[quantity_source]
    fifo = F.col("method") == "FIFO"
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ledger_cost = F.when(fifo, zero("cost_fifo")).otherwise(zero("cost_average"))
    rows = rows.withColumns(
        {
            "currency": F.coalesce("ledger_currency", "trade_currency", "snap_currency", "base_currency"),
            "quantity": F.when(from_snap, F.col("snap_quantity")).otherwise(zero("ledger_quantity")),
            "quantity_source": F.when(from_snap, "snapshot").otherwise("ledger"),
            "cost_basis": F.when(from_snap, F.col("snap_cost")).otherwise(ledger_cost),
            "realized_pnl": F.when(fifo, zero("realized_fifo")).otherwise(zero("realized_average")),
            "excluded": F.coalesce("_excluded", F.lit(False)),
        }
    )
    rows = rows.withColumn("priced", _priced(F.col("currency")))
    scaled = F.coalesce(F.col("multiplier"), F.lit(1.0)) != 1.0
    rows = rows.withColumns(
        {
            "price": F.col("priced.price"), "price_currency": F.col("priced.currency"),
            "price_source": F.col("priced.source"), "price_as_of": F.col("priced.as_of"),
            # contract multipliers are not modelled, so such a position stays unvalued
            "market_value": F.when(~scaled, F.col("quantity") * F.col("priced.price")),
        }
    )
    rows = fx.with_rate(rows, "price_currency", "base_currency", "valued_on", rates, rate="price_rate")
    rows = fx.with_rate(rows, "currency", "base_currency", "valued_on", rates, rate="cost_rate")
    home = F.col("currency") == F.col("base_currency")
    no_lots = from_snap | F.col("lots_gap").isNull()
    stretch = F.when(zero("cost_fifo") == 0, F.lit(1.0)).otherwise(F.col("cost_basis") / F.col("cost_fifo"))
    cost_base = (
        F.when(home, F.col("cost_basis")).when(is_zero("cost_basis"), F.lit(0.0))
        .when(no_lots, F.col("cost_basis") * F.col("cost_rate"))
        .when(~F.col("lots_gap"), F.col("lots_base") * stretch)
    )
    realized_base = (
        F.when(home, F.col("realized_pnl")).when(F.col("sales_gap").isNull(), F.lit(0.0))
        .when(~F.col("sales_gap"), F.col("sales_base"))
    )
    rows = rows.withColumns(
        {
            "market_value_base": F.col("market_value") * F.col("price_rate"),
            "cost_basis_base": cost_base, "realized_pnl_base": realized_base,
            "closed": is_zero("quantity"),
            "avg_unit_cost": F.when(F.col("quantity") > 0, F.col("cost_basis") / F.col("quantity")),
        }
    )
    checked = has_snap & ~from_snap
    diff = F.when(checked, zero("ledger_at") - F.col("snap_quantity"))
    rows = rows.withColumns(
        {
            "unrealized_pnl": F.when(F.col("price_currency") == F.col("currency"), F.col("market_value") - F.col("cost_basis")),
            "unrealized_pnl_base": F.col("market_value_base") - F.col("cost_basis_base"),
            "unpriced": F.col("market_value").isNull() & ~F.col("closed") & ~F.col("excluded"),
            "missing_fx": (F.col("market_value").isNotNull() & F.col("market_value_base").isNull())
            | ((F.col("cost_basis") != 0) & F.col("cost_basis_base").isNull())
            | F.col("realized_pnl_base").isNull(),
            "check_ledger": F.when(checked, zero("ledger_at")), "check_snapshot": F.when(checked, F.col("snap_quantity")),
            "check_difference": diff,
            "discrepancy": F.coalesce(F.abs(diff) > F.lit(tolerance), F.lit(False)),
            "symbol": F.coalesce(F.nullif(F.col("display_symbol"), F.lit("")), F.nullif(F.col("symbol"), F.lit("")), F.col("instrument_key").cast("string")),
            "name": F.coalesce(F.col("name"), F.col("symbol"), F.col("instrument_key").cast("string")),
            "asset_category": F.coalesce(F.col("asset_category"), F.lit("Stocks")),
            "uncovered_shares": zero("uncovered"), "reopens": F.coalesce(F.col("reopens"), F.lit(0)),
        }
    )
    rows = rows.withColumn("total_pnl_base", F.col("unrealized_pnl_base") + F.col("realized_pnl_base"))
    out = rows.select(
        *LEDGER, "symbol", "name", "asset_category", "aliases", "trade_currency", "div_currency", "base_currency", "valued_on",
        "currency", "quantity", "quantity_source", "method", "cost_basis", "cost_basis_base", "avg_unit_cost",
        "price", "price_currency", "price_source", "price_as_of", "market_value", "market_value_base",
        "unrealized_pnl", "unrealized_pnl_base", "realized_pnl", "realized_pnl_base", "total_pnl_base",
        "closed", "excluded", "uncovered_shares", "reopens", "first_purchase", "unpriced", "missing_fx",
        F.col("snap_as_of").alias("check_as_of"), "check_ledger", "check_snapshot", "check_difference", "discrepancy",
        "quote_source",
    )
    return with_weights(cut_lineage(out))  # read twice


def with_weights(holdings: DataFrame) -> DataFrame:
    """Add each counted position's share (0..100) of the priced portfolio total."""
    total = holdings.where(~F.col("excluded")).groupBy("portfolio_id").agg(
        sum_known("market_value_base").alias("_total")
    )
    share = F.when(~F.col("excluded"), pct("market_value_base", "_total"))
    return holdings.join(total, "portfolio_id", "left").withColumn("weight_pct", share).drop("_total")


def totals(holdings: DataFrame) -> DataFrame:
    """Portfolio totals and how many open positions each of them covers."""
    counted = ~F.col("excluded")
    held = counted & ~F.col("closed")
    known = lambda c: sum_known(F.when(counted, F.col(c)))
    cost_n = F.count_if(held & F.col("cost_basis_base").isNotNull())
    value_n = F.count_if(held & F.col("market_value_base").isNotNull())
    return holdings.groupBy("portfolio_id").agg(
        F.first("base_currency").alias("base_currency"), F.max("valued_on").alias("as_of"),
        known("market_value_base").alias("market_value_base"), known("cost_basis_base").alias("cost_basis_base"),
        known("unrealized_pnl_base").alias("unrealized_pnl_base"), known("realized_pnl_base").alias("realized_pnl_base"),
        F.count_if(held).alias("open_positions"), cost_n.alias("cost_covered"), value_n.alias("value_covered"),
        ((cost_n == F.count_if(held)) & (value_n == F.count_if(held))).alias("aggregates_comparable"),
        F.count_if(F.col("unpriced")).alias("unpriced"), F.count_if(F.col("missing_fx")).alias("missing_fx"),
        F.count_if(F.col("discrepancy")).alias("discrepancies"),
    )


def issues(holdings: DataFrame) -> DataFrame:
    """Long list of exceptions: (portfolio, instrument, kind)."""
    kinds = F.array_compact(
        F.array(*[F.when(F.col(k), F.lit(k)) for k in ("unpriced", "missing_fx", "discrepancy")])
    )
    return holdings.select(*LEDGER, F.explode(kinds).alias("kind"))


def issue_summary(holdings: DataFrame, distributions_missing: DataFrame, flows_missing: DataFrame, stale_rows: DataFrame) -> DataFrame:
    """Data-quality counts (portfolio, code, n) over all issue sources."""
    kept = holdings.where(~F.col("excluded"))
    found = issues(kept).select("portfolio_id", F.col("kind").alias("code"))
    found = found.unionByName(kept.where(F.col("uncovered_shares") > 0).select("portfolio_id", F.lit("uncovered").alias("code")))
    for df, code in ((distributions_missing, "dividend_fx"), (flows_missing, "flow_fx"), (stale_rows, "stale_history")):
        found = found.unionByName(df.select("portfolio_id", F.lit(code).alias("code")))
    return found.groupBy("portfolio_id", "code").agg(F.count(F.lit(1)).alias("n"))


def dividends_received(distributions: DataFrame, settings: DataFrame, rates: fx.RateTable, *, net: bool = False) -> DataFrame:
    """All-time dividends in base, irregular ones included, and those without a rate."""
    rows = distributions.where(F.col("superseded_at").isNull()) if "superseded_at" in distributions.columns else distributions
    rows = rows.join(settings.select("portfolio_id", "base_currency"), "portfolio_id")
    rows = fx.convert(rows, {"_base": "net" if net else "gross"}, "currency", "base_currency", "pay_date", rates)
    return rows.groupBy("portfolio_id").agg(
        sum_known("_base").alias("dividends_base"), F.count_if(F.col("_base").isNull()).alias("dividends_missing_fx")
    )


def profit(totals_: DataFrame, dividends: DataFrame) -> DataFrame:
    """Total profit incl. dividends; NULL unless all parts cover the same positions."""
    rows = totals_.join(dividends, "portfolio_id", "left")
    missing = F.coalesce("dividends_missing_fx", F.lit(0))
    ok = F.col("aggregates_comparable") & (missing == 0)
    total = F.when(
        ok, F.col("unrealized_pnl_base") + F.col("realized_pnl_base") + F.coalesce("dividends_base", F.lit(0.0))
    )
    cost = F.col("cost_basis_base")
    return rows.withColumn("total_pnl_base", total).withColumn(
        "total_pnl_pct", F.when(cost > 0, F.col("total_pnl_base") / cost * 100)
    )


def position_view(holdings: DataFrame, position_yields: DataFrame, coverage: DataFrame) -> DataFrame:
    """Row view: gain %, and income figures only where they were measurable.

    `coverage` has one row per position with its forecast class and flags.
    """
    rows = holdings.join(position_yields, LEDGER, "left").join(
        coverage.select(*LEDGER, "coverage", "stale", "income_fx_gap"), LEDGER, "left"
    )
    known = F.col("forward_income_base").isNotNull() & ~F.coalesce(F.col("coverage") == "missing", F.lit(False)) & ~F.coalesce("income_fx_gap", F.lit(False))
    return rows.withColumns(
        {
            "pnl_pct": pct("unrealized_pnl_base", "cost_basis_base"),
            "income_base": F.when(known, F.col("forward_income_base")),
            "yield_pct": F.when(known, F.col("forward_yield_pct")),
            "yield_on_cost_pct": F.when(known, F.col("yield_on_cost_pct")),
            "declared_only": F.coalesce(F.col("coverage") == "declared_only", F.lit(False)),
            "no_dividend_data": F.coalesce(F.col("coverage") == "missing", F.lit(False)),
        }
    )


def visible_totals(rows: DataFrame) -> DataFrame:
    """Footer over listed rows: NULL when every value is NULL, 0 when no rows count."""
    counted = ~F.col("excluded")

    def total(c: str) -> Column:
        x = F.when(counted, F.col(c))
        return F.when(F.count_if(counted) == 0, F.lit(0.0)).otherwise(exact_sum(x))

    out = rows.groupBy("portfolio_id").agg(
        total("market_value_base").alias("value"), total("cost_basis_base").alias("cost"),
        total("unrealized_pnl_base").alias("pnl"), total("realized_pnl_base").alias("realized"),
        total("weight_pct").alias("weight_pct"), F.count_if(counted).alias("counted"),
        F.count_if(~counted).alias("excluded"),
        F.count_if(counted & F.col("market_value_base").isNull() & F.col("market_value").isNull()).alias("no_price"),
        F.count_if(counted & F.col("market_value_base").isNull() & F.col("market_value").isNotNull()).alias("no_value_fx"),
    )
    return out.withColumn("pnl_pct", pct("pnl", "cost"))


def known_totals(totals_: DataFrame, coverage: DataFrame) -> DataFrame:
    """Headline value only where something was measurable or nothing is held."""
    rows = totals_.join(coverage, "portfolio_id", "left")
    none_open = F.col("open_positions") == 0
    return rows.withColumns(
        {
            "value_known": F.when(none_open | (F.col("value_covered") > 0), F.col("market_value_base")),
            "income_known": F.when(
                none_open | (F.coalesce("estimated", F.lit(0)) + F.coalesce("declared", F.lit(0)) > 0), F.col("forward_base")
            ),
        }
    )


def allocation(holdings: DataFrame, by: str = "instrument_key") -> DataFrame:
    """Value and weight per instrument or currency over open, priced positions."""
    kept = holdings.where(~F.col("excluded") & ~F.col("closed") & (F.col("market_value_base") > 0))
    return kept.groupBy("portfolio_id", F.col(by).alias("slice")).agg(
        exact_sum("market_value_base").alias("value"),
        F.when(~F.bool_or(F.col("weight_pct").isNull()), exact_sum("weight_pct")).alias("weight_pct"),
    )


def price_age(holdings: DataFrame, now: str) -> DataFrame:
    """Age class of each price; manual and statement prices are exempt."""
    hours = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("price_as_of").cast("timestamp"))) / 3600.0
    exempt = F.col("price_source").isin("manual", "snapshot") | F.coalesce(F.col("quote_source").isin("manual", "statement"), F.lit(False))
    return holdings.withColumn(
        "price_age",
        F.when(F.col("price_as_of").isNull(), F.lit(None)).when(exempt, "ok").when(hours > 72, "critical").when(hours > 24, "warn").otherwise("ok"),
    )


def search(holdings: DataFrame, text: str) -> DataFrame:
    """Case-insensitive match on symbol, name, key or any alias."""
    needle = F.lit(text.strip().lower())
    hit = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), needle))
    for c in ("symbol", "name", "instrument_key"):
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), needle)
    return holdings.where(hit)
