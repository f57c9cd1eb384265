"""Dividend income.  Cash-flow views bucket by pay date, entitlement views by ex date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions import calendar as cal
from ledgerspark.functions.numeric import clamp, exact_sum, pct, ratio, sum_known
from ledgerspark.operators import fx
from ledgerspark.operators.lots import LEDGER

# Distributions that are not regular income, and sentinel labels.
IRREGULAR = "(?i)return of capital|payment in lieu|special"
UNATTRIBUTED = "__unknown"
UNATTRIBUTED_LABEL = "Unattributed"
UNMATCHED = "(unmatched)"


def is_regular() -> Column:
    """Neither the type nor the description names an irregular payment."""
    hit = lambda c: F.coalesce(F.col(c).rlike(IRREGULAR), F.lit(False))
    return ~hit("div_type") & ~hit("description")


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("superseded_at").isNull()) if "superseded_at" in df.columns else df


def payments(distributions: DataFrame, *, regular_only: bool = True, start: str | None = None, end: str | None = None) -> DataFrame:
    """Live payments with a pay date, regular by default, inside [start, end]."""
    rows = live(distributions).where(F.col("pay_date").isNotNull())
    if regular_only:
        rows = rows.where(is_regular())
    if start:
        rows = rows.where(F.col("pay_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("pay_date") <= F.lit(end).cast("date"))
    return rows


def attributed(rows: DataFrame, unknown: str = UNATTRIBUTED) -> DataFrame:
    """Add `group_key`: the instrument, else the one linked to its ISIN, else the ISIN."""
    linked = F.col("instrument_key").isNotNull() & F.col("isin").isNotNull()
    link = rows.where(linked).groupBy("portfolio_id", "isin").agg(F.min_by("instrument_key", "id").alias("_linked"))
    # only rows without an instrument need the lookup
    named = F.col("isin").isNotNull()
    orphans = rows.where(F.col("instrument_key").isNull())
    linked_rows = orphans.where(named).join(link, ["portfolio_id", "isin"], "left")
    linked_rows = linked_rows.withColumn("group_key", F.coalesce(F.col("_linked").cast("string"), F.col("isin"))).drop("_linked")
    nameless = orphans.where(~named).withColumn("group_key", F.lit(unknown))
    direct = rows.where(F.col("instrument_key").isNotNull()).withColumn("group_key", F.col("instrument_key").cast("string"))
    return direct.unionByName(linked_rows).unionByName(nameless)


def in_base(rows: DataFrame, settings: DataFrame, rates: fx.RateTable) -> DataFrame:
    """Gross and tax of each payment in base at one rate, that of its pay date."""
    rows = rows.join(settings.select("portfolio_id", "base_currency"), "portfolio_id")
    return fx.convert(rows, {"gross_base": "gross", "tax_base": "tax"}, "currency", "base_currency", "pay_date", rates)


def _sums(net: bool) -> dict[str, Column]:
    ok = F.col("gross_base").isNotNull() & F.col("tax_base").isNotNull()
    gross, tax = F.when(ok, F.col("gross_base")), F.when(ok, F.col("tax_base"))
    return {
        "gross": sum_known(gross), "tax": sum_known(tax), "net": sum_known(gross - tax),
        "count": F.count_if(ok), "missing_fx": F.count_if(~ok),
    }


def by_period(
    distributions: DataFrame, period: str, settings: DataFrame, rates: fx.RateTable, *,
    net: bool = False, regular_only: bool = True, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Dense month, quarter or year buckets per portfolio; empty periods are zero rows."""
    rows = payments(distributions, regular_only=regular_only, start=start, end=end)
    sums = _sums(net)
    facts = in_base(rows, settings, rates).groupBy(
        "portfolio_id", cal.period_start("pay_date", period).alias("start")
    ).agg(*[e.alias(n) for n, e in sums.items()])
    first = F.lit(start).cast("date") if start else F.min("pay_date")
    last = F.lit(end).cast("date") if end else F.max("pay_date")
    spans = rows.groupBy("portfolio_id").agg(first.alias("_a"), last.alias("_b"))
    dense = spans.select("portfolio_id", F.explode(cal.period_series("_a", "_b", period)).alias("start"))
    out = dense.join(facts, ["portfolio_id", "start"], "left").fillna(0.0, ["gross", "tax", "net"]).fillna(0, ["count", "missing_fx"])
    return out.select(
        "portfolio_id", cal.period_key("start", period).alias("period"), "start", cal.period_end("start", period).alias("end"),
        "gross", "tax", "net", F.col("net" if net else "gross").alias("amount"), "count", "missing_fx",
    )


def by_period_and_instrument(
    distributions: DataFrame, period: str, settings: DataFrame, rates: fx.RateTable, *,
    net: bool = False, regular_only: bool = True, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Contribution of each instrument to each bucket (only those that paid)."""
    rows = attributed(payments(distributions, regular_only=regular_only, start=start, end=end))
    rows = in_base(rows, settings, rates).where(F.col("gross_base").isNotNull() & F.col("tax_base").isNotNull())
    value = F.col("gross_base") - F.col("tax_base") if net else F.col("gross_base")
    return rows.groupBy("portfolio_id", cal.period_key("pay_date", period).alias("period"), "group_key").agg(
        exact_sum(value).alias("amount")
    )


def contribution_order(parts: DataFrame) -> DataFrame:
    """Rank instruments by total contribution, ties on the key."""
    total = parts.groupBy("portfolio_id", "group_key").agg(exact_sum("amount").alias("total"))
    w = W.partitionBy("portfolio_id").orderBy(F.col("total").desc(), "group_key")
    return total.withColumn("rank", F.row_number().over(w))


def split_map(parts: DataFrame) -> DataFrame:
    """The per-instrument split of each bucket as one map (instruments per bucket are few)."""
    pairs = F.array_sort(F.collect_list(F.struct("group_key", "amount")))
    return parts.groupBy("portfolio_id", "period").agg(F.map_from_entries(pairs).alias("by_instrument"))


def payments_matrix(
    distributions: DataFrame, settings: DataFrame, rates: fx.RateTable, *, net: bool = False, regular_only: bool = True,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Instruments x months with row, column and grand totals in long form.

    A total has NULL in the summed-out column; `level` tells the four kinds apart.
    """
    rows = attributed(payments(distributions, regular_only=regular_only, start=start, end=end), UNMATCHED)
    rows = in_base(rows, settings, rates)
    ok = F.col("gross_base").isNotNull() & F.col("tax_base").isNotNull()
    value = F.col("gross_base") - F.col("tax_base") if net else F.col("gross_base")
    # one row per cell first, so the four-fold expansion works on cells, not payments
    cells = rows.groupBy("portfolio_id", "group_key", cal.month_key("pay_date").alias("month")).agg(
        exact_sum(F.when(ok, value)).alias("cell"), F.count_if(~ok).alias("missing_fx")
    )
    p, k, m = F.col("portfolio_id"), F.col("group_key"), F.col("month")
    cube = cells.groupingSets([[p, k, m], [p, k], [p, m], [p]], p, k, m).agg(
        exact_sum("cell").alias("amount"), F.sum("missing_fx").alias("missing_fx"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 0, "cell").when(F.col("_g") == 1, "row").when(F.col("_g") == 2, "column").otherwise("grand")
    return cube.withColumn("level", level).drop("_g")


def matrix_wide(matrix: DataFrame, months: list[str]) -> DataFrame:
    """One row per instrument with a column per month; absent cells are 0."""
    wide = matrix.where(F.col("level") == "cell").groupBy("portfolio_id", "group_key").pivot("month", months).agg(
        F.first("amount")
    )
    return wide.fillna(0.0, months)


def matrix_by_year(matrix: DataFrame) -> DataFrame:
    """One row per instrument and year that has a payment, columns m01 to m12; absent cells are 0."""
    names = [f"{i:02d}" for i in range(1, 13)]
    cells = matrix.where(F.col("level") == "cell").withColumns({"year": F.substring("month", 1, 4), "_m": F.substring("month", 6, 2)})
    wide = cells.groupBy("portfolio_id", "group_key", "year").pivot("_m", names).agg(F.first("amount")).fillna(0.0, names)
    return wide.select("portfolio_id", "group_key", "year", *[F.col(m).alias(f"m{m}") for m in names])


def display_symbols(instruments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Symbol to print per instrument: the override when set, else the instrument's own."""
    own = instruments.select(*LEDGER, "symbol")
    put = overrides.select(*LEDGER, "display_symbol")
    return own.join(put, LEDGER, "full_outer").select(
        *LEDGER, F.coalesce(F.nullif(F.col("display_symbol"), F.lit("")), F.col("symbol")).alias("symbol")
    )


def with_labels(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Label of each `group_key`: symbol, else the key; the sentinel reads Unattributed."""
    look = symbols.select("portfolio_id", F.col("instrument_key").cast("string").alias("group_key"), "symbol")
    own = F.coalesce(F.nullif(F.col("symbol"), F.lit("")), F.col("group_key"))
    return rows.join(look, ["portfolio_id", "group_key"], "left").withColumn(
        "label", F.when(F.col("group_key") == UNATTRIBUTED, UNATTRIBUTED_LABEL).otherwise(own)
    ).drop("symbol")


def trailing_year(col: str, as_of: str) -> Column:
    """Half-open window of 365 days ending at `as_of`."""
    day = F.lit(as_of).cast("date")
    return (F.col(col) > F.date_sub(day, 365)) & (F.col(col) <= day)


def ttm_from_statements(distributions: DataFrame, as_of: str, *, regular_only: bool = True) -> DataFrame:
    """Trailing twelve months per share by ex date; no row without a payment."""
    rows = live(distributions).where(trailing_year("ex_date", as_of) & F.col("per_share").isNotNull())
    rows = rows.where(is_regular()) if regular_only else rows
    return rows.groupBy(*LEDGER).agg(
        exact_sum("per_share").alias("ttm_per_share"), F.min_by("currency", F.struct("ex_date", "id")).alias("currency"),
        F.count(F.lit(1)).alias("payments"),
    )


def ttm_from_profiles(profiles: DataFrame, profile_rows: DataFrame, as_of: str, *, include_projected: bool = False) -> DataFrame:
    """Trailing twelve months per share from a dividend profile, else its own stated figure."""
    by = [c for c in LEDGER if c in profiles.columns]
    rows = profile_rows.where(trailing_year("ex_date", as_of))
    rows = rows if include_projected else rows.where("declared")
    seen = rows.groupBy(*by).agg(
        exact_sum("amount").alias("_sum"), F.count(F.lit(1)).alias("payments"),
        F.min_by("currency", "ex_date").alias("_row_currency"),
    )
    out = profiles.join(seen, by, "left").withColumn("_ttm", F.coalesce("_sum", F.col("ttm_per_share").cast("double")))
    return out.where(F.col("_ttm").isNotNull()).select(
        *by, F.col("_ttm").alias("ttm_per_share"), F.coalesce("currency", "_row_currency").alias("currency"),
        F.coalesce("payments", F.lit(0)).alias("payments"),
    )


def withholding(distributions: DataFrame, by: list[str]) -> DataFrame:
    """Tax actually withheld over gross, clamped to [0, 1], per group.

    Without an instrument in `by`, group by currency as well: sums across
    currencies have no meaning.
    """
    rows = live(distributions).where(is_regular())
    r = clamp(F.col("_r"), 0.0, 1.0)
    out = rows.groupBy(*by).agg(ratio(exact_sum("tax"), exact_sum("gross")).alias("_r"))
    return out.where(F.col("_r").isNotNull()).select(*by, r.alias("withholding_rate"))


def position_yields(holdings: DataFrame, forward: DataFrame) -> DataFrame:
    """Forward income, forward yield and yield on cost per counted position."""
    rows = holdings.where(~F.col("excluded")).select(*LEDGER, "market_value_base", "cost_basis_base")
    rows = rows.join(forward.select(*LEDGER, "forward_base"), LEDGER, "left")
    income = F.coalesce("forward_base", F.lit(0.0))
    return rows.select(
        *LEDGER, income.alias("forward_income_base"), pct(income, "market_value_base").alias("forward_yield_pct"),
        pct(income, "cost_basis_base").alias("yield_on_cost_pct"),
    )


def portfolio_yields(totals: DataFrame, forward_totals: DataFrame, cash: DataFrame | None = None) -> DataFrame:
    """Ratios of sums: forward yield without and with cash, and yield on cost."""
    rows = totals.select("portfolio_id", "market_value_base", "cost_basis_base").join(forward_totals, "portfolio_id", "left")
    if cash is not None:
        rows = rows.join(cash.select("portfolio_id", "cash_base"), "portfolio_id", "left")
    else:
        rows = rows.withColumn("cash_base", F.lit(0.0))
    income = F.coalesce("forward_base", F.lit(0.0))
    with_cash = F.col("market_value_base") + F.coalesce("cash_base", F.lit(0.0))
    return rows.select(
        "portfolio_id", income.alias("forward_income_base"), "market_value_base", with_cash.alias("market_value_cash_base"),
        "cost_basis_base", pct(income, "market_value_base").alias("forward_yield_ex_cash_pct"),
        pct(income, with_cash).alias("forward_yield_incl_cash_pct"), pct(income, "cost_basis_base").alias("yield_on_cost_pct"),
    )


def trailing_twelve(monthly: DataFrame, as_of: str) -> DataFrame:
    """Total and average of the last twelve months; the divisor is months elapsed."""
    end = F.trunc(F.lit(as_of).cast("date"), "month")
    begin = F.add_months(end, -11)
    inside = F.col("start").between(begin, end)
    agg = monthly.groupBy("portfolio_id").agg(
        sum_known(F.when(inside, F.col("amount"))).alias("total"), F.min("start").alias("_first")
    )
    months = F.least(F.lit(12), F.greatest(F.lit(1), cal.months_between(F.greatest("_first", begin), end) + 1))
    return agg.select("portfolio_id", "total", months.alias("months"), (F.col("total") / months).alias("average"))


def best_month(monthly: DataFrame) -> DataFrame:
    """Largest positive bucket; the earliest wins ties."""
    key = F.struct("amount", (-F.datediff("start", F.lit("1970-01-01").cast("date"))).alias("early"))
    agg = monthly.where(F.col("amount") > 0).groupBy("portfolio_id").agg(F.max_by(F.struct("period", "amount"), key).alias("b"))
    return agg.select("portfolio_id", "b.period", "b.amount")


def overview(distributions: DataFrame) -> DataFrame:
    """Irregular payments and the first pay date per portfolio."""
    return live(distributions).groupBy("portfolio_id").agg(
        F.count_if(~is_regular()).alias("irregular"), F.min("pay_date").alias("first_payment"), F.count(F.lit(1)).alias("payments")
    )


def recent_payments(distributions: DataFrame, size: int, page: int = 0) -> DataFrame:
    """One page of payments per portfolio, newest first."""
    w = W.partitionBy("portfolio_id").orderBy(F.col("pay_date").desc(), "id")
    top = live(distributions).where(F.col("pay_date").isNotNull()).withColumn("position", F.row_number().over(w))
    # the bound is pushed below the shuffle as a per-partition limit
    return top.where(F.col("position") <= size * (page + 1)).where(F.col("position") > size * page)


def heat_bands(cells: DataFrame, value: str = "amount", bands: int = 5) -> DataFrame:
    """Band 1..5 of each cell against the portfolio maximum; 0 for nothing paid."""
    top = cells.groupBy("portfolio_id").agg(F.max(value).alias("_max"))
    share = F.least(F.lit(1.0), F.col(value) / F.col("_max"))
    band = F.least(F.lit(bands), F.floor(share * bands).cast("int") + 1)
    return cells.join(top, "portfolio_id").withColumn(
        "band", F.when((F.col(value) > 0) & (F.col("_max") > 0), band).otherwise(F.lit(0))
    ).drop("_max")
