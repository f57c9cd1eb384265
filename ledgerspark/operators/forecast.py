"""Twelve months of expected income: declared accruals, then seasonal estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions import calendar as cal
from ledgerspark.functions.numeric import EPS_QTY, exact_sum, is_zero, sum_known
from ledgerspark.operators import fx
from ledgerspark.operators.lots import LEDGER
from ledgerspark.operators.rank import fold_other

# Smallest declared amount worth listing, accepted ex-to-pay lag, horizon.
FLOOR = 0.02
MAX_LAG = 6
MONTHS = 12


def _keys(df: DataFrame) -> list[str]:
    """Market data may be shared by all portfolios or be given per portfolio."""
    return [c for c in LEDGER if c in df.columns]


def seasonality(profile_rows: DataFrame, as_of: str, *, include_projected: bool = False) -> DataFrame:
    """Share of the yearly amount per month of the ex date, one row per instrument and month.

    Looks at the 365 days up to `as_of`, else at the last 365 days on record
    (then `stale`).  Payments are first added up per day, which bounds every
    later step by the calendar.
    """
    rows = profile_rows if include_projected else profile_rows.where("declared")
    by = _keys(profile_rows)
    gap = cal.months_between("ex_date", "pay_date")
    lag = F.when(gap.between(0, MAX_LAG), gap)
    daily = rows.where(F.col("ex_date").isNotNull()).groupBy(*by, "ex_date", lag.alias("lag")).agg(
        exact_sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")
    )
    day = F.lit(as_of).cast("date")
    recent = (F.col("ex_date") > F.date_sub(day, 365)) & (F.col("ex_date") <= day)
    per = W.partitionBy(*by)
    daily = daily.withColumns({"fresh": F.max(recent.cast("int")).over(per), "latest": F.max("ex_date").over(per)})
    end = F.when(F.col("fresh") == 1, day).otherwise(F.least(F.col("latest"), day))
    daily = daily.withColumn("window_end", end).where(
        (F.col("ex_date") > F.date_sub("window_end", 365)) & (F.col("ex_date") <= F.col("window_end"))
    )
    shape = daily.groupBy(*by).agg(
        exact_sum("amount").alias("per_share_total"), F.sum("n").alias("payments"),
        F.coalesce(F.floor(F.percentile("lag", 0.5, F.when(F.col("lag").isNull(), 1).otherwise(F.col("n"))) + 0.5), F.lit(0)).cast("int").alias("lag_months"),
        (F.max("fresh") == 0).alias("stale"),
    ).where(~is_zero("per_share_total", 1e-12))
    months = daily.groupBy(*by, cal.month_of_year("ex_date").alias("ex_month")).agg(exact_sum("amount").alias("month_amount"))
    return months.join(shape, by).select(
        *by, "ex_month", (F.col("month_amount") / F.col("per_share_total")).alias("weight"),
        "per_share_total", "payments", "lag_months", "stale",
    )


def _anchor(as_of: str) -> Column:
    return F.trunc(F.lit(as_of).cast("date"), "month")


def declared_items(accruals: DataFrame, holdings: DataFrame, settings: DataFrame, rates: fx.RateTable, as_of: str) -> DataFrame:
    """Open accruals paying inside the horizon, above the floor, of instruments not excluded."""
    first = _anchor(as_of)
    last = F.date_sub(F.add_months(first, MONTHS), 1)
    rows = accruals.where(F.col("open") & F.col("pay_date").between(first, last))
    if "superseded_at" in rows.columns:
        rows = rows.where(F.col("superseded_at").isNull())
    rows = rows.where((F.abs("net") >= FLOOR) | (F.abs("gross") >= FLOOR))
    rows = rows.join(holdings.where("excluded").select(*LEDGER), LEDGER, "left_anti")
    rows = rows.join(settings.select("portfolio_id", "base_currency"), "portfolio_id")
    rows = fx.convert(rows, {"gross_base": "gross", "net_base": "net"}, "currency", "base_currency", F.lit(as_of).cast("date"), rates)
    return rows.select(
        *LEDGER, cal.month_key("pay_date").alias("month"), F.lit("declared").alias("basis"), "pay_date", "ex_date",
        F.month("ex_date").alias("ex_month"), "quantity", F.col("gross_rate").alias("per_share"), "currency",
        "gross", "tax", "net", "gross_base", "net_base",
    )


def estimated_items(
    holdings: DataFrame, profiles: DataFrame, seasons: DataFrame, declared: DataFrame, settings: DataFrame,
    rates: fx.RateTable, as_of: str, withholding: DataFrame | None = None,
) -> DataFrame:
    """Seasonal estimate per open holding and pay month, unless that month is declared."""
    kept = holdings.where(~F.col("excluded") & (F.col("quantity") > EPS_QTY)).select(
        *LEDGER, "quantity", F.col("currency").alias("holding_currency"), "trade_currency", "div_currency"
    )
    payers = profiles.where("is_distributing").select(*_keys(profiles), F.col("currency").alias("profile_currency"))
    rows = kept.join(payers, _keys(profiles)).join(seasons, _keys(seasons)).where(F.col("weight") > 0)
    if withholding is not None:
        rows = rows.join(withholding.select(*LEDGER, "withholding_rate"), LEDGER, "left")
    else:
        rows = rows.withColumn("withholding_rate", F.lit(0.0))
    first = _anchor(as_of)
    pay_month = F.pmod(F.col("ex_month") - 1 + F.col("lag_months"), F.lit(12)) + 1
    offset = F.pmod(pay_month - F.month(first), F.lit(12))
    per_share = F.col("per_share_total") * F.col("weight")
    gross = per_share * F.col("quantity")
    tax = gross * F.coalesce("withholding_rate", F.lit(0.0))
    rows = rows.withColumns(
        {
            "month": cal.month_key(F.add_months(first, offset)), "per_share": per_share, "gross": gross, "tax": tax,
            "net": gross - tax, "currency": F.coalesce("profile_currency", "div_currency", "trade_currency", "holding_currency"),
        }
    )
    rows = rows.join(declared.select(*LEDGER, "month").distinct(), [*LEDGER, "month"], "left_anti")
    rows = rows.join(declared.where(F.col("ex_month").isNotNull()).select(*LEDGER, "ex_month").distinct(), [*LEDGER, "ex_month"], "left_anti")
    rows = rows.join(settings.select("portfolio_id", "base_currency"), "portfolio_id")
    rows = fx.convert(rows, {"gross_base": "gross", "net_base": "net"}, "currency", "base_currency", F.lit(as_of).cast("date"), rates)
    none = F.lit(None).cast("date")
    return rows.select(
        *LEDGER, "month", F.lit("estimated").alias("basis"), none.alias("pay_date"), none.alias("ex_date"), "ex_month",
        "quantity", "per_share", "currency", "gross", "tax", "net", "gross_base", "net_base",
    )


def items(
    holdings: DataFrame, accruals: DataFrame, profiles: DataFrame, profile_rows: DataFrame, settings: DataFrame,
    rates: fx.RateTable, as_of: str, *, withholding: DataFrame | None = None, include_projected: bool = False,
) -> DataFrame:
    """Declared and estimated items of the coming twelve months.

    Pass the measured `withholding` per instrument to net estimates down; without
    it net equals gross for estimates.
    """
    declared = declared_items(accruals, holdings, settings, rates, as_of)
    seasons = seasonality(profile_rows, as_of, include_projected=include_projected)
    return declared.unionByName(
        estimated_items(holdings, profiles, seasons, declared, settings, rates, as_of, withholding)
    )


def months(items_: DataFrame, portfolios: DataFrame, as_of: str, *, net: bool = False) -> DataFrame:
    """Twelve dense month rows per portfolio: gross, net, declared and estimated."""
    amount = F.col("net_base") if net else F.col("gross_base")
    facts = items_.groupBy("portfolio_id", "month").agg(
        sum_known("gross_base").alias("gross_base"), sum_known("net_base").alias("net_base"),
        sum_known(F.when(F.col("basis") == "declared", amount)).alias("declared_base"),
        sum_known(F.when(F.col("basis") == "estimated", amount)).alias("estimated_base"),
    )
    first = _anchor(as_of)
    starts = F.sequence(first, F.add_months(first, MONTHS - 1), F.expr("interval 1 month"))
    grid = portfolios.select("portfolio_id").distinct().withColumn("start", F.explode(starts))
    grid = grid.withColumn("month", cal.month_key("start"))
    return grid.join(facts, ["portfolio_id", "month"], "left").fillna(
        0.0, ["gross_base", "net_base", "declared_base", "estimated_base"]
    )


def totals(items_: DataFrame, portfolios: DataFrame, *, net: bool = False) -> DataFrame:
    """Totals by basis; NULL where items exist but none could be converted."""
    amount = F.col("net_base") if net else F.col("gross_base")

    def total(basis: str) -> Column:
        x = F.when(F.col("basis") == basis, amount)
        return F.when(F.count_if(F.col("basis") == basis) == 0, F.lit(0.0)).otherwise(exact_sum(x))

    facts = items_.groupBy("portfolio_id").agg(
        total("declared").alias("declared_base"), total("estimated").alias("estimated_base"),
        sum_known("gross_base").alias("gross_base"), sum_known("net_base").alias("net_base"),
        F.count_if(F.col("basis") == "declared").alias("declared"),
    )
    rows = portfolios.select("portfolio_id").distinct().join(facts, "portfolio_id", "left")
    has_items = F.col("declared").isNotNull()
    zero = lambda c: F.when(~has_items, F.lit(0.0)).otherwise(F.col(c))
    d, e = zero("declared_base"), zero("estimated_base")
    share = F.when((d + e) > 0, d / (d + e) * 100)
    return rows.select(
        "portfolio_id", d.alias("declared_base"), e.alias("estimated_base"), zero("gross_base").alias("gross_base"),
        zero("net_base").alias("net_base"), zero("net_base" if net else "gross_base").alias("forward_base"), share.alias("declared_pct"),
        F.coalesce("declared", F.lit(0)).alias("declared"),
    )


def coverage(holdings: DataFrame, profiles: DataFrame, seasons: DataFrame, items_: DataFrame) -> DataFrame:
    """Forecast class of every open position, with stale and missing-rate flags."""
    kept = holdings.where(~F.col("excluded") & (F.col("quantity") > EPS_QTY)).select(*LEDGER)
    shape = seasons.groupBy(*_keys(seasons)).agg(F.bool_or("stale").alias("_stale"))
    known = profiles.select(*_keys(profiles), F.lit(True).alias("_profile"), "is_distributing")
    seen = items_.groupBy(*LEDGER).agg(
        F.bool_or(F.col("basis") == "declared").alias("_accrual"),
        F.bool_or(F.col("gross_base").isNull() | F.col("net_base").isNull()).alias("_gap"),
    )
    rows = kept.join(known, _keys(profiles), "left").join(shape, _keys(seasons), "left").join(seen, LEDGER, "left")
    accrual = F.coalesce("_accrual", F.lit(False))
    shaped = F.col("_profile").isNotNull() & F.col("_stale").isNotNull()
    kind = (
        F.when(shaped & F.col("is_distributing"), "estimated").when(shaped, "not_distributing")
        .when(accrual, "declared_only").when(F.col("_profile").isNull() | F.col("is_distributing"), "missing")
        .otherwise("not_distributing")
    )
    return rows.select(
        *LEDGER, kind.alias("coverage"), ((kind == "estimated") & F.col("_stale")).alias("stale"),
        F.coalesce("_gap", F.lit(False)).alias("income_fx_gap"),
    )


def coverage_totals(coverage_: DataFrame) -> DataFrame:
    """Counts per forecast class and the estimated share of open positions."""
    n = F.count(F.lit(1))
    est = F.count_if(F.col("coverage") == "estimated")
    return coverage_.groupBy("portfolio_id").agg(
        n.alias("positions"), est.alias("estimated"), F.count_if(F.col("coverage") == "declared_only").alias("declared_only"),
        F.count_if(F.col("coverage") == "missing").alias("missing"), F.count_if("stale").alias("stale"),
        F.count_if("income_fx_gap").alias("missing_fx"), (est / n).alias("ratio"),
    )


def forward_by_instrument(items_: DataFrame, *, net: bool = False) -> DataFrame:
    amount = F.col("net_base") if net else F.col("gross_base")
    return items_.groupBy(*LEDGER).agg(sum_known(amount).alias("forward_base"))


def upcoming(items_: DataFrame, as_of: str, k: int = 10) -> DataFrame:
    """Next payments per portfolio; undated estimates follow the dated ones of a month."""
    future = items_.where(F.col("pay_date").isNull() | (F.col("pay_date") >= F.lit(as_of).cast("date")))
    when = F.coalesce(F.date_format("pay_date", "yyyy-MM-dd"), F.concat("month", F.lit("-99")))
    w = W.partitionBy("portfolio_id").orderBy(when, F.coalesce("gross_base", F.lit(0.0)).desc(), "instrument_key", "basis")
    return future.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def concentration(forward: DataFrame, k: int = 6) -> DataFrame:
    """Positive forward income as shares, the largest `k` and one Other row."""
    rows = forward.where(F.col("forward_base") > 0).withColumn("instrument_key", F.col("instrument_key").cast("string"))
    folded = fold_other(rows, ["portfolio_id"], [], "instrument_key", "forward_base", k)
    total = rows.groupBy("portfolio_id").agg(exact_sum("forward_base").alias("_total"))
    return folded.join(total, "portfolio_id").withColumn("share_pct", F.col("forward_base") / F.col("_total") * 100).drop("_total")
