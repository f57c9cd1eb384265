"""Query bank: each entry runs operators over the whole provided tables.

The SQL next to a query gives the same result in another engine and is what the
correctness check compares with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.numeric import exact_sum
from ledgerspark.operators import dedupe, forecast, fx, gate, holdings, income, lots, quotes, rank, returns, scan
from ledgerspark.plans import adapters as A
from ledgerspark.plans import ingest
from ledgerspark.plans.oracle_views import sql
from ledgerspark.plans.store import EventStore
from ledgerspark.plans.portfolio import Portfolio, Tables
from ledgerspark.sources import statements
from ledgerspark.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BASES = ["EUR", "USD"]


def query(name: str, views: str = "", body: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if body is not None:
            ORACLES[name] = sql(views, body) if views else body
        return f

    return add


def r6(*cols: str, dp: int = 6) -> list:
    return [F.round(F.col(c).cast("double"), dp).alias(c) for c in cols]


def _rates(spark: SparkSession, sf: str) -> fx.RateTable:
    return fx.resolve_rates(A.fx_rates(spark, sf), BASES)


_SHARED: dict[tuple[str, str], Portfolio] = {}


def _portfolio(spark: SparkSession, sf: str) -> Portfolio:
    """The composed view over one folder; its stages are computed once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SHARED:
        _SHARED[key] = _compose(spark, sf)
    return _SHARED[key]


def _compose(spark: SparkSession, sf: str) -> Portfolio:
    t = A.trades(spark, sf)
    tables = Tables(
        transactions=t, positions=A.positions(t), instruments=A.instruments(t), quotes=A.quotes(spark, sf, t), overrides=A.overrides(t),
        settings=A.settings(A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("portfolio_id"))), fx_rates=A.fx_rates(spark, sf),
        distributions=A.distributions(spark, sf), accruals=A.accruals(spark, sf), cash_events=A.cash_events(spark, sf),
        profiles=A.profiles(spark, sf), profile_rows=A.profile_rows(spark, sf),
    )
    return Portfolio(tables, A.AS_OF, bases=BASES)


def _dist_settings(spark: SparkSession, sf: str) -> DataFrame:
    return A.settings(A.table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("portfolio_id")))


# --- lots -----------------------------------------------------------------------------------

@query("fifo_consumption", "v_cons", """
SELECT portfolio_id, instrument_key, sale_id, lot_id, lot_date, round(quantity, 6) AS quantity, round(cost, 3) AS cost FROM v_cons""")
def _(spark, sf):
    c = lots.replay(A.trades(spark, sf)).lot_consumption()
    return c.select("portfolio_id", "instrument_key", "sale_id", "lot_id", "lot_date", *r6("quantity"), *r6("cost", dp=3))


@query("open_lots", "v_open", """
SELECT portfolio_id, instrument_key, lot_id, lot_date, round(quantity, 6) AS quantity, round(unit_cost, 6) AS unit_cost,
       round(fee_per_share, 6) AS fee_per_share, round(cost, 3) AS cost FROM v_open""")
def _(spark, sf):
    o = lots.replay(A.trades(spark, sf)).open_lots()
    return o.select("portfolio_id", "instrument_key", "lot_id", "lot_date", *r6("quantity", "unit_cost", "fee_per_share"), *r6("cost", dp=3))


@query("realized_sales", "v_sales", """
SELECT portfolio_id, instrument_key, sale_id, sale_date, quantity, round(proceeds_net, 3) AS proceeds_net, round(cost_fifo, 3) AS cost_fifo,
       round(proceeds_net - cost_fifo, 3) AS realized_fifo, round(cost_average, 3) AS cost_average,
       round(proceeds_net - cost_average, 3) AS realized_average, CAST(uncovered AS DOUBLE) AS uncovered FROM v_sales""")
def _(spark, sf):
    s = lots.replay(A.trades(spark, sf)).sales()
    return s.select(
        "portfolio_id", "instrument_key", "sale_id", "sale_date", "quantity", *r6("proceeds_net", "cost_fifo", "realized_fifo", dp=3),
        *r6("cost_average", "realized_average", dp=3), "uncovered",
    )


@query("ledger_summary", "v_ledger", """
SELECT portfolio_id, instrument_key, currency, CAST(quantity AS DOUBLE) AS quantity, round(total_cost, 3) AS total_cost, round(total_proceeds, 3) AS total_proceeds,
       round(total_fees, 3) AS total_fees, round(cost_fifo, 3) AS cost_fifo, round(cost_average, 3) AS cost_average,
       round(realized_fifo, 3) AS realized_fifo, round(realized_average, 3) AS realized_average, CAST(uncovered AS DOUBLE) AS uncovered,
       CAST(reopens AS BIGINT) AS reopens, first_activity, last_activity, buy_count, sell_count FROM v_ledger""")
def _(spark, sf):
    s = lots.replay(A.trades(spark, sf)).summary()
    return s.select(
        "portfolio_id", "instrument_key", "currency", "quantity", *r6("total_cost", "total_proceeds", "total_fees", "cost_fifo", "cost_average", "realized_fifo", "realized_average", dp=3),
        "uncovered", F.col("reopens").cast("long").alias("reopens"), "first_activity", "last_activity", "buy_count", "sell_count",
    )


@query("total_gain", "v_ledger", """
SELECT portfolio_id, instrument_key, round(total_proceeds + quantity * 1000e0 - total_cost, 3) AS gain_fifo,
       round(total_proceeds + quantity * 1000e0 - total_cost, 3) AS gain_average FROM v_ledger""")
def _(spark, sf):
    s = lots.replay(A.trades(spark, sf)).summary()
    value = F.col("quantity") * 1000.0
    return s.select(
        "portfolio_id", "instrument_key",
        F.round(F.col("realized_fifo") + value - F.col("cost_fifo"), 3).alias("gain_fifo"),
        F.round(F.col("realized_average") + value - F.col("cost_average"), 3).alias("gain_average"),
    )


@query("first_purchase", "v_open v_cons", """
SELECT portfolio_id, instrument_key, min(lot_date) AS first_purchase
FROM (SELECT portfolio_id, instrument_key, lot_date FROM v_open UNION ALL SELECT portfolio_id, instrument_key, lot_date FROM v_cons) GROUP BY 1, 2""")
def _(spark, sf):
    s = lots.replay(A.trades(spark, sf)).summary()
    return s.where(F.col("first_purchase").isNotNull()).select("portfolio_id", "instrument_key", "first_purchase")


@query("quantity_as_of", "v_trades", """
SELECT portfolio_id, instrument_key, DATE '1999-06-30' AS as_of, coalesce(sum(quantity) FILTER (date <= DATE '1999-06-30'), 0e0) AS ledger_quantity
FROM v_trades GROUP BY 1, 2""")
def _(spark, sf):
    t = A.trades(spark, sf)
    dates = t.select("portfolio_id", "instrument_key").distinct().withColumn("as_of", F.lit("1999-06-30").cast("date"))
    return lots.quantity_as_of(t, dates)


# --- currency -------------------------------------------------------------------------------

@query("fx_lookup", "v_trades v_rate v_settings", """
SELECT t.src, t.dst, t.day, round(CASE WHEN t.src = t.dst THEN 1e0 ELSE r.rate END, 9) AS rate,
       CASE WHEN t.src = t.dst THEN t.day ELSE r.rate_date END AS rate_date, CASE WHEN t.src <> t.dst THEN r.via END AS via
FROM (SELECT DISTINCT currency AS src, base_currency AS dst, date AS day FROM v_trades JOIN v_settings USING (portfolio_id)) t
LEFT JOIN v_rate r USING (src, dst, day)""")
def _(spark, sf):
    t = A.trades(spark, sf)
    asked = t.join(A.settings(t), "portfolio_id").select(F.col("currency").alias("src"), F.col("base_currency").alias("dst"), F.col("date").alias("day")).distinct()
    out = fx.with_rate(asked, "src", "dst", "day", _rates(spark, sf), rate_date="rate_date", via="via")
    return out.select("src", "dst", "day", *r6("rate", dp=9), "rate_date", "via")


@query("fx_convert", "v_trades v_rate v_settings", """
SELECT portfolio_id, currency, count(*) AS trades, count(*) FILTER (amount IS NULL) AS missing, round(coalesce(sum(amount), 0e0), 2) AS amount_base
FROM (SELECT t.portfolio_id, t.currency, t.quantity * t.price * (CASE WHEN t.currency = s.base_currency THEN 1e0 ELSE r.rate END) AS amount
      FROM v_trades t JOIN v_settings s USING (portfolio_id)
      LEFT JOIN v_rate r ON r.src = t.currency AND r.dst = s.base_currency AND r.day = t.date) GROUP BY 1, 2""")
def _(spark, sf):
    t = A.trades(spark, sf)
    rows = t.withColumn("amount", F.col("quantity") * F.col("price")).join(A.settings(t), "portfolio_id")
    rows = fx.convert(rows, {"amount_base": "amount"}, "currency", "base_currency", "date", _rates(spark, sf))
    return rows.groupBy("portfolio_id", "currency").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("amount_base").isNull()).alias("missing"),
        F.round(F.coalesce(exact_sum("amount_base"), F.lit(0.0)), 2).alias("amount_base"),
    )


@query("fx_requirements", "v_trades v_settings", """
SELECT t.portfolio_id, base_currency, currency, any_value(d0) AS date_from, DATE '2001-08-01' AS date_to
FROM v_trades t JOIN v_settings USING (portfolio_id) JOIN (SELECT portfolio_id, least(min(date), DATE '2001-08-01') AS d0 FROM v_trades GROUP BY 1) m USING (portfolio_id)
WHERE currency <> base_currency GROUP BY 1, 2, 3""")
def _(spark, sf):
    t = A.trades(spark, sf)
    return fx.required_currencies(t, A.positions(t), A.instruments(t), A.settings(t), A.AS_OF)


# --- holdings -------------------------------------------------------------------------------

@query("holdings", "v_holdings", """
SELECT portfolio_id, instrument_key, currency, CAST(quantity AS DOUBLE) AS quantity, round(cost_basis, 3) AS cost_basis, round(price, 6) AS price, price_source,
       round(market_value, 3) AS market_value, round(market_value_base, 3) AS market_value_base, round(cost_basis_base, 3) AS cost_basis_base,
       round(market_value_base - cost_basis_base, 3) AS unrealized_pnl_base, round(realized_pnl, 3) AS realized_pnl, round(realized_pnl_base, 3) AS realized_pnl_base,
       closed, excluded, round(CASE WHEN NOT excluded THEN market_value_base / nullif(t.total, 0e0) * 100 END, 6) AS weight_pct
FROM v_holdings JOIN (SELECT portfolio_id, coalesce(sum(market_value_base) FILTER (NOT excluded), 0e0) AS total FROM v_holdings GROUP BY 1) t USING (portfolio_id)""")
def _(spark, sf):
    h = _portfolio(spark, sf).holdings
    return h.select(
        "portfolio_id", "instrument_key", "currency", "quantity", *r6("cost_basis", dp=3), *r6("price"), "price_source",
        *r6("market_value", "market_value_base", "cost_basis_base", "unrealized_pnl_base", "realized_pnl", "realized_pnl_base", dp=3),
        "closed", "excluded", *r6("weight_pct"),
    )


@query("portfolio_totals", "v_totals", """
SELECT portfolio_id, round(market_value_base, 2) AS market_value_base, round(cost_basis_base, 2) AS cost_basis_base, round(unrealized_pnl_base, 2) AS unrealized_pnl_base,
       round(realized_pnl_base, 2) AS realized_pnl_base, open_positions, cost_covered, value_covered,
       cost_covered = open_positions AND value_covered = open_positions AS aggregates_comparable FROM v_totals""")
def _(spark, sf):
    t = _portfolio(spark, sf).totals
    return t.select("portfolio_id", *r6("market_value_base", "cost_basis_base", "unrealized_pnl_base", "realized_pnl_base", dp=2), "open_positions", "cost_covered", "value_covered", "aggregates_comparable")


@query("holding_issues", "v_holdings", """
SELECT portfolio_id, instrument_key, 'unpriced' AS kind FROM v_holdings WHERE market_value IS NULL AND NOT closed AND NOT excluded
UNION ALL SELECT portfolio_id, instrument_key, 'missing_fx' FROM v_holdings
WHERE (market_value IS NOT NULL AND market_value_base IS NULL) OR (cost_basis <> 0 AND cost_basis_base IS NULL) OR realized_pnl_base IS NULL
UNION ALL SELECT portfolio_id, instrument_key, 'discrepancy' FROM v_holdings WHERE abs(coalesce(check_ledger, 0e0) - check_snapshot) > 1e-6""")
def _(spark, sf):
    return holdings.issues(_portfolio(spark, sf).holdings)


@query("quantity_check", "v_last_pos v_trades", """
SELECT p.portfolio_id, p.instrument_key, p.as_of AS check_as_of, sum(t.quantity) AS check_ledger, any_value(p.quantity) AS check_snapshot,
       sum(t.quantity) - any_value(p.quantity) AS check_difference
FROM v_last_pos p JOIN v_trades t ON t.portfolio_id = p.portfolio_id AND t.instrument_key = p.instrument_key AND t.date <= p.as_of GROUP BY 1, 2, 3""")
def _(spark, sf):
    h = _portfolio(spark, sf).holdings.where(F.col("check_snapshot").isNotNull())
    return h.select("portfolio_id", "instrument_key", "check_as_of", "check_ledger", "check_snapshot", "check_difference")


@query("allocation_currency", "v_holdings", """
SELECT h.portfolio_id, currency AS slice, round(sum(market_value_base), 2) AS value, round(sum(market_value_base / t.total * 100), 6) AS weight_pct
FROM v_holdings h JOIN (SELECT portfolio_id, sum(market_value_base) AS total FROM v_holdings WHERE NOT excluded GROUP BY 1) t USING (portfolio_id)
WHERE NOT excluded AND NOT closed AND market_value_base > 0 GROUP BY 1, 2""")
def _(spark, sf):
    a = holdings.allocation(_portfolio(spark, sf).holdings, "currency")
    return a.select("portfolio_id", "slice", *r6("value", dp=2), *r6("weight_pct"))


@query("allocation_top", "v_holdings", """
SELECT portfolio_id, slice, round(sum(v), 2) AS value FROM (
  SELECT portfolio_id, CASE WHEN row_number() OVER (PARTITION BY portfolio_id ORDER BY v DESC, k) <= 8 THEN k ELSE '__other' END AS slice, v
  FROM (SELECT portfolio_id, CAST(instrument_key AS VARCHAR) AS k, sum(market_value_base) AS v FROM v_holdings
        WHERE NOT excluded AND NOT closed AND market_value_base > 0 GROUP BY 1, 2)) GROUP BY 1, 2""")
def _(spark, sf):
    a = holdings.allocation(_portfolio(spark, sf).holdings).withColumn("slice", F.col("slice").cast("string"))
    return rank.fold_other(a, ["portfolio_id"], [], "slice", "value", 8).select("portfolio_id", "slice", *r6("value", dp=2))


@query("portfolio_profit", "v_totals v_dist v_rate v_settings", """
SELECT t.portfolio_id, round(coalesce(d.total, 0e0), 2) AS dividends_base, coalesce(d.missing, 0) AS dividends_missing_fx,
       round(CASE WHEN cost_covered = open_positions AND value_covered = open_positions AND coalesce(d.missing, 0) = 0
             THEN unrealized_pnl_base + realized_pnl_base + coalesce(d.total, 0e0) END, 2) AS total_pnl_base
FROM v_totals t LEFT JOIN (
  SELECT portfolio_id, coalesce(sum(g), 0e0) AS total, count(*) FILTER (g IS NULL) AS missing FROM (
    SELECT d.portfolio_id, d.gross * (CASE WHEN d.currency = s.base_currency THEN 1e0 ELSE r.rate END) AS g FROM v_dist d JOIN v_settings s USING (portfolio_id)
    LEFT JOIN v_rate r ON r.src = d.currency AND r.dst = s.base_currency AND r.day = d.pay_date) GROUP BY 1) d USING (portfolio_id)""")
def _(spark, sf):
    p = _portfolio(spark, sf).profit
    return p.select(
        "portfolio_id", F.round(F.coalesce("dividends_base", F.lit(0.0)), 2).alias("dividends_base"),
        F.coalesce("dividends_missing_fx", F.lit(0)).alias("dividends_missing_fx"), *r6("total_pnl_base", dp=2),
    )


@query("visible_totals", "v_holdings", """
SELECT portfolio_id, round(sum(market_value_base) FILTER (NOT excluded), 2) AS value, round(sum(cost_basis_base) FILTER (NOT excluded), 2) AS cost,
       round(sum(realized_pnl_base) FILTER (NOT excluded), 2) AS realized, count(*) FILTER (NOT excluded) AS counted,
       count(*) FILTER (NOT excluded AND market_value IS NULL) AS no_price,
       count(*) FILTER (NOT excluded AND market_value IS NOT NULL AND market_value_base IS NULL) AS no_value_fx
FROM v_holdings GROUP BY 1""")
def _(spark, sf):
    v = holdings.visible_totals(_portfolio(spark, sf).holdings)
    return v.select("portfolio_id", *r6("value", "cost", "realized", dp=2), "counted", "no_price", "no_value_fx")


# --- income ---------------------------------------------------------------------------------

def _bucket_sql(period: str, key: str) -> str:
    return f"""
SELECT c.portfolio_id, {key} AS period, c.start, round(coalesce(f.gross, 0e0), 2) AS gross, round(coalesce(f.tax, 0e0), 2) AS tax,
       round(coalesce(f.net, 0e0), 2) AS net, coalesce(f.n, 0) AS count, coalesce(f.missing, 0) AS missing_fx
FROM (SELECT portfolio_id, CAST(unnest(generate_series(date_trunc('{period}', min(pay_date))::TIMESTAMP, max(pay_date)::TIMESTAMP, INTERVAL 1 {period})) AS DATE) AS start
      FROM v_pay GROUP BY 1) c
LEFT JOIN (SELECT portfolio_id, CAST(date_trunc('{period}', pay_date) AS DATE) AS start, sum(gross) AS gross, sum(tax) AS tax, sum(gross - tax) AS net,
                  count(gross) AS n, count(*) FILTER (gross IS NULL) AS missing FROM v_pay GROUP BY 1, 2) f USING (portfolio_id, start)"""


def _income(period: str) -> Query:
    def run(spark, sf):
        b = income.by_period(A.distributions(spark, sf), period, _dist_settings(spark, sf), _rates(spark, sf))
        return b.select("portfolio_id", "period", "start", *r6("gross", "tax", "net", dp=2), "count", "missing_fx")

    return run


for _p, _k in (("month", "strftime(c.start, '%Y-%m')"), ("quarter", "strftime(c.start, '%Y') || '-Q' || quarter(c.start)"), ("year", "strftime(c.start, '%Y')")):
    query(f"income_{_p}", "v_pay", _bucket_sql(_p, _k))(_income(_p))


@query("income_by_instrument", "v_pay", """
SELECT portfolio_id, strftime(pay_date, '%Y') AS period, group_key, round(sum(gross), 2) AS amount FROM v_pay WHERE gross IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = income.by_period_and_instrument(A.distributions(spark, sf), "year", _dist_settings(spark, sf), _rates(spark, sf))
    return p.select("portfolio_id", "period", "group_key", *r6("amount", dp=2))


@query("contribution_order", "v_pay", """
SELECT portfolio_id, group_key, round(total, 2) AS total, CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY total DESC, group_key) AS INT) AS rank
FROM (SELECT portfolio_id, group_key, sum(gross) AS total FROM v_pay WHERE gross IS NOT NULL GROUP BY 1, 2)""")
def _(spark, sf):
    p = income.by_period_and_instrument(A.distributions(spark, sf), "year", _dist_settings(spark, sf), _rates(spark, sf))
    return income.contribution_order(p).select("portfolio_id", "group_key", *r6("total", dp=2), "rank")


@query("payments_matrix", "v_pay", """
SELECT portfolio_id, CASE group_key WHEN '__unknown' THEN '(unmatched)' ELSE group_key END AS group_key, month, round(amount, 2) AS amount, missing_fx,
       CASE g WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'grand' END AS level
FROM (SELECT portfolio_id, group_key, month, sum(gross) AS amount, count(*) FILTER (gross IS NULL) AS missing_fx, grouping(group_key, month) AS g
      FROM (SELECT *, strftime(pay_date, '%Y-%m') AS month FROM v_pay)
      GROUP BY GROUPING SETS ((portfolio_id, group_key, month), (portfolio_id, group_key), (portfolio_id, month), (portfolio_id)))""")
def _(spark, sf):
    m = income.payments_matrix(A.distributions(spark, sf), _dist_settings(spark, sf), _rates(spark, sf))
    return m.select("portfolio_id", "group_key", "month", *r6("amount", dp=2), "missing_fx", "level")


_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]  # every month that orders span


@query("matrix_wide", "v_pay", """
SELECT portfolio_id, CASE group_key WHEN '__unknown' THEN '(unmatched)' ELSE group_key END AS group_key,
       """ + ", ".join(f"round(coalesce(sum(gross) FILTER (strftime(pay_date, '%Y-%m') = '{m}'), 0e0), 2) AS \"{m}\"" for m in _MONTHS) + """
FROM v_pay GROUP BY 1, 2""")
def _(spark, sf):
    m = income.payments_matrix(A.distributions(spark, sf), _dist_settings(spark, sf), _rates(spark, sf))
    return income.matrix_wide(m, _MONTHS).select("portfolio_id", "group_key", *[F.round(F.col(f"`{c}`"), 2).alias(c) for c in _MONTHS])


@query("matrix_by_year", "v_pay", """
SELECT portfolio_id, CASE group_key WHEN '__unknown' THEN '(unmatched)' ELSE group_key END AS group_key, strftime(pay_date, '%Y') AS year,
       """ + ", ".join(f"round(coalesce(sum(gross) FILTER (month(pay_date) = {m}), 0e0), 2) AS m{m:02d}" for m in range(1, 13)) + """
FROM v_pay GROUP BY 1, 2, 3""")
def _(spark, sf):
    m = income.payments_matrix(A.distributions(spark, sf), _dist_settings(spark, sf), _rates(spark, sf))
    return income.matrix_by_year(m).select("portfolio_id", "group_key", "year", *r6(*[f"m{i:02d}" for i in range(1, 13)], dp=2))


@query("ttm_ex_date", "v_dist", """
SELECT portfolio_id, instrument_key, round(sum(per_share), 6) AS ttm_per_share, count(*) AS payments FROM v_dist
WHERE ex_date > DATE '2001-08-01' - 365 AND ex_date <= DATE '2001-08-01' AND NOT irregular GROUP BY 1, 2""")
def _(spark, sf):
    return income.ttm_from_statements(A.distributions(spark, sf), A.AS_OF).select("portfolio_id", "instrument_key", *r6("ttm_per_share"), "payments")


@query("ttm_profile", "v_profiles v_prof_rows", """
SELECT p.instrument_key, round(coalesce(s.t, 2.5e0), 6) AS ttm_per_share, p.currency, coalesce(s.n, 0) AS payments
FROM v_profiles p LEFT JOIN (SELECT instrument_key, sum(amount) AS t, count(*) AS n FROM v_prof_rows
  WHERE declared AND ex_date > DATE '2001-08-01' - 365 AND ex_date <= DATE '2001-08-01' GROUP BY 1) s USING (instrument_key)""")
def _(spark, sf):
    t = income.ttm_from_profiles(A.profiles(spark, sf), A.profile_rows(spark, sf), A.AS_OF)
    return t.select("instrument_key", *r6("ttm_per_share"), "currency", "payments")


@query("withholding", "v_dist", """
SELECT portfolio_id, instrument_key, currency, round(greatest(least(sum(tax) / sum(gross), 1e0), 0e0), 9) AS withholding_rate FROM v_dist WHERE NOT irregular GROUP BY 1, 2, 3""")
def _(spark, sf):
    return income.withholding(A.distributions(spark, sf), ["portfolio_id", "instrument_key", "currency"]).select(
        "portfolio_id", "instrument_key", "currency", *r6("withholding_rate", dp=9))


@query("trailing_twelve", "v_pay", """
SELECT portfolio_id, round(total, 2) AS total, CAST(months AS INT) AS months, round(total / months, 2) AS average FROM (
  SELECT portfolio_id, coalesce(sum(gross) FILTER (pay_date >= DATE '2000-09-01' AND pay_date < DATE '2001-09-01'), 0e0) AS total,
         least(12, greatest(1, (2001 - year(greatest(date_trunc('month', min(pay_date)), DATE '2000-09-01'))) * 12 + 8 - month(greatest(date_trunc('month', min(pay_date)), DATE '2000-09-01')) + 1)) AS months
  FROM v_pay GROUP BY 1)""")
def _(spark, sf):
    b = income.by_period(A.distributions(spark, sf), "month", _dist_settings(spark, sf), _rates(spark, sf))
    return income.trailing_twelve(b, A.AS_OF).select("portfolio_id", *r6("total", dp=2), "months", *r6("average", dp=2))


@query("best_month", "v_pay", """
SELECT portfolio_id, arg_max(m, (v, -epoch(m_start))) AS period, round(max(v), 2) AS amount FROM (
  SELECT portfolio_id, strftime(pay_date, '%Y-%m') AS m, min(date_trunc('month', pay_date))::TIMESTAMP AS m_start, sum(gross) AS v FROM v_pay WHERE gross IS NOT NULL GROUP BY 1, 2)
WHERE v > 0 GROUP BY 1""")
def _(spark, sf):
    b = income.by_period(A.distributions(spark, sf), "month", _dist_settings(spark, sf), _rates(spark, sf))
    return income.best_month(b).select("portfolio_id", "period", *r6("amount", dp=2))


@query("income_overview", "v_dist", """
SELECT portfolio_id, count(*) FILTER (irregular) AS irregular, min(pay_date) AS first_payment, count(*) AS payments FROM v_dist GROUP BY 1""")
def _(spark, sf):
    return income.overview(A.distributions(spark, sf))


@query("recent_payments", "v_dist", """
SELECT portfolio_id, id, pay_date, round(gross, 2) AS gross, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY pay_date DESC, id) AS position FROM v_dist) WHERE position BETWEEN 11 AND 20""")
def _(spark, sf):
    return income.recent_payments(A.distributions(spark, sf), 10, 1).select("portfolio_id", "id", "pay_date", *r6("gross", dp=2), "position")


@query("heat_bands", "v_pay", """
SELECT portfolio_id, period, CAST(CASE WHEN v > 0 AND m > 0 THEN least(5, floor(least(1e0, v / m) * 5) + 1) ELSE 0 END AS INT) AS band FROM (
  SELECT *, max(v) OVER (PARTITION BY portfolio_id) AS m FROM (
    SELECT c.portfolio_id, strftime(c.start, '%Y-%m') AS period, coalesce(sum(p.gross), 0e0) AS v
    FROM (SELECT portfolio_id, CAST(unnest(generate_series(date_trunc('month', min(pay_date))::TIMESTAMP, max(pay_date)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS start FROM v_pay GROUP BY 1) c
    LEFT JOIN v_pay p ON p.portfolio_id = c.portfolio_id AND CAST(date_trunc('month', p.pay_date) AS DATE) = c.start GROUP BY 1, 2))""")
def _(spark, sf):
    b = income.by_period(A.distributions(spark, sf), "month", _dist_settings(spark, sf), _rates(spark, sf))
    return income.heat_bands(b).select("portfolio_id", "period", "band")


@query("topk_other", "v_pay", """
SELECT portfolio_id, period, k AS group_key, round(sum(v), 2) AS amount FROM (
  SELECT c.portfolio_id, c.period, CASE WHEN r.rn <= 5 THEN c.group_key ELSE '__other' END AS k, c.v
  FROM (SELECT portfolio_id, strftime(pay_date, '%Y') AS period, group_key, sum(gross) AS v FROM v_pay WHERE gross IS NOT NULL GROUP BY 1, 2, 3) c
  JOIN (SELECT portfolio_id, group_key, row_number() OVER (PARTITION BY portfolio_id ORDER BY sum(gross) DESC, group_key) AS rn FROM v_pay WHERE gross IS NOT NULL GROUP BY 1, 2) r
  USING (portfolio_id, group_key)) GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = income.by_period_and_instrument(A.distributions(spark, sf), "year", _dist_settings(spark, sf), _rates(spark, sf))
    return rank.fold_other(p, ["portfolio_id"], ["period"], "group_key", "amount", 5).select("portfolio_id", "period", "group_key", *r6("amount", dp=2))


# --- forecast -------------------------------------------------------------------------------

@query("seasonality", "v_seasons", """
SELECT instrument_key, CAST(ex_month AS INT) AS ex_month, round(weight, 9) AS weight, round(per_share_total, 6) AS per_share_total, CAST(payments AS BIGINT) AS payments, lag_months, stale FROM v_seasons""")
def _(spark, sf):
    s = forecast.seasonality(A.profile_rows(spark, sf), A.AS_OF)
    return s.select("instrument_key", "ex_month", *r6("weight", dp=9), *r6("per_share_total"), "payments", "lag_months", "stale")


@query("forecast_items", "v_items", """
SELECT portfolio_id, instrument_key, month, basis, pay_date, round(gross_base, 3) AS gross_base, round(net_base, 3) AS net_base FROM v_items""")
def _(spark, sf):
    i = _portfolio(spark, sf).forecast_items
    return i.select("portfolio_id", "instrument_key", "month", "basis", "pay_date", *r6("gross_base", "net_base", dp=3))


@query("forecast_months", "v_items v_trades", """
SELECT p.portfolio_id, p.month, round(coalesce(sum(gross_base), 0e0), 2) AS gross_base, round(coalesce(sum(net_base), 0e0), 2) AS net_base,
       round(coalesce(sum(gross_base) FILTER (basis = 'declared'), 0e0), 2) AS declared_base, round(coalesce(sum(gross_base) FILTER (basis = 'estimated'), 0e0), 2) AS estimated_base
FROM (SELECT portfolio_id, strftime(m, '%Y-%m') AS month FROM (SELECT DISTINCT portfolio_id FROM v_trades),
      (SELECT unnest(generate_series(TIMESTAMP '2001-08-01', TIMESTAMP '2002-07-01', INTERVAL 1 MONTH)) AS m)) p
LEFT JOIN v_items i USING (portfolio_id, month) GROUP BY 1, 2""")
def _(spark, sf):
    m = _portfolio(spark, sf).forecast_months
    return m.select("portfolio_id", "month", *r6("gross_base", "net_base", "declared_base", "estimated_base", dp=2))


@query("forecast_totals", "v_items v_trades", """
SELECT p.portfolio_id, round(CASE WHEN count(i.basis) FILTER (basis = 'declared') = 0 THEN 0e0 ELSE sum(gross_base) FILTER (basis = 'declared') END, 2) AS declared_base,
       round(CASE WHEN count(i.basis) FILTER (basis = 'estimated') = 0 THEN 0e0 ELSE sum(gross_base) FILTER (basis = 'estimated') END, 2) AS estimated_base
FROM (SELECT DISTINCT portfolio_id FROM v_trades) p LEFT JOIN v_items i USING (portfolio_id) GROUP BY 1""")
def _(spark, sf):
    t = _portfolio(spark, sf).forecast_totals
    return t.select("portfolio_id", *r6("declared_base", "estimated_base", dp=2))


@query("forecast_coverage", "v_holdings v_profiles v_seasons v_items v_declared", """
SELECT portfolio_id, count(*) AS positions, count(*) FILTER (k = 'estimated') AS estimated, count(*) FILTER (k = 'declared_only') AS declared_only,
       count(*) FILTER (k = 'missing') AS missing, count(*) FILTER (k = 'estimated' AND stale) AS stale, count(*) FILTER (gap) AS missing_fx,
       round(count(*) FILTER (k = 'estimated') / count(*), 6) AS ratio
FROM (SELECT h.portfolio_id, z.stale, coalesce(i.gap, false) AS gap,
        CASE WHEN z.stale IS NOT NULL AND p.is_distributing THEN 'estimated' WHEN z.stale IS NOT NULL AND p.is_distributing IS NOT NULL THEN 'none' WHEN d.instrument_key IS NOT NULL THEN 'declared_only'
             WHEN p.instrument_key IS NULL OR p.is_distributing THEN 'missing' ELSE 'none' END AS k
      FROM v_holdings h LEFT JOIN v_profiles p USING (instrument_key)
      LEFT JOIN (SELECT instrument_key, bool_or(stale) AS stale FROM v_seasons GROUP BY 1) z USING (instrument_key)
      LEFT JOIN (SELECT DISTINCT portfolio_id, instrument_key FROM v_declared) d ON d.portfolio_id = h.portfolio_id AND d.instrument_key = h.instrument_key
      LEFT JOIN (SELECT portfolio_id, instrument_key, bool_or(gross_base IS NULL) AS gap FROM v_items GROUP BY 1, 2) i ON i.portfolio_id = h.portfolio_id AND i.instrument_key = h.instrument_key
      WHERE NOT h.excluded AND h.quantity > 1e-9) GROUP BY 1""")
def _(spark, sf):
    c = forecast.coverage_totals(_portfolio(spark, sf).coverage)
    return c.select("portfolio_id", "positions", "estimated", "declared_only", "missing", "stale", "missing_fx", *r6("ratio"))


@query("upcoming_payments", "v_items", """
SELECT portfolio_id, instrument_key, month, basis, round(gross_base, 3) AS gross_base, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY coalesce(strftime(pay_date, '%Y-%m-%d'), month || '-99'), coalesce(gross_base, 0e0) DESC, instrument_key, basis) AS position FROM v_items)
WHERE position <= 10""")
def _(spark, sf):
    u = forecast.upcoming(_portfolio(spark, sf).forecast_items, A.AS_OF)
    return u.select("portfolio_id", "instrument_key", "month", "basis", *r6("gross_base", dp=3), "position")


@query("income_concentration", "v_items", """
, f AS (SELECT portfolio_id, CAST(instrument_key AS VARCHAR) AS k, sum(gross_base) AS v FROM v_items GROUP BY 1, 2 HAVING sum(gross_base) > 0)
SELECT portfolio_id, s AS instrument_key, round(sum(v), 2) AS forward_base, round(sum(v) / any_value(t) * 100, 4) AS share_pct FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY portfolio_id ORDER BY v DESC, k) <= 6 THEN k ELSE '__other' END AS s, sum(v) OVER (PARTITION BY portfolio_id) AS t FROM f) GROUP BY 1, 2""")
def _(spark, sf):
    f = forecast.forward_by_instrument(_portfolio(spark, sf).forecast_items)
    return forecast.concentration(f).select("portfolio_id", "instrument_key", *r6("forward_base", dp=2), *r6("share_pct", dp=4))


@query("portfolio_yields", "v_totals v_items", """
SELECT t.portfolio_id, round(coalesce(i.f, 0e0), 2) AS forward_income_base, round(coalesce(i.f, 0e0) / nullif(market_value_base, 0e0) * 100, 6) AS forward_yield_ex_cash_pct,
       round(coalesce(i.f, 0e0) / nullif(cost_basis_base, 0e0) * 100, 6) AS yield_on_cost_pct
FROM v_totals t LEFT JOIN (SELECT portfolio_id, coalesce(sum(gross_base), 0e0) AS f FROM v_items GROUP BY 1) i USING (portfolio_id)""")
def _(spark, sf):
    y = _portfolio(spark, sf).yields
    return y.select("portfolio_id", *r6("forward_income_base", dp=2), *r6("forward_yield_ex_cash_pct", "yield_on_cost_pct"))


@query("position_yields", "v_holdings v_items", """
SELECT h.portfolio_id, h.instrument_key, round(coalesce(i.f, 0e0), 3) AS forward_income_base, round(coalesce(i.f, 0e0) / nullif(market_value_base, 0e0) * 100, 6) AS forward_yield_pct,
       round(coalesce(i.f, 0e0) / nullif(cost_basis_base, 0e0) * 100, 6) AS yield_on_cost_pct
FROM v_holdings h LEFT JOIN (SELECT portfolio_id, instrument_key, coalesce(sum(gross_base), 0e0) AS f FROM v_items GROUP BY 1, 2) i USING (portfolio_id, instrument_key) WHERE NOT excluded""")
def _(spark, sf):
    y = _portfolio(spark, sf).position_yields
    return y.select("portfolio_id", "instrument_key", *r6("forward_income_base", dp=3), *r6("forward_yield_pct", "yield_on_cost_pct"))


# --- returns --------------------------------------------------------------------------------

@query("invested", "v_flows_base", """
SELECT portfolio_id, round(coalesce(sum(amount_base), 0e0), 2) AS invested_base, count(*) FILTER (amount_base IS NULL) AS missing_fx FROM v_flows_base GROUP BY 1""")
def _(spark, sf):
    f = returns.external_flows(A.cash_events(spark, sf), _dist_settings(spark, sf), _rates(spark, sf))
    return returns.invested(f).select("portfolio_id", *r6("invested_base", dp=2), "missing_fx")


_XIRR = """
, d AS (SELECT portfolio_id, CAST(date - min(date) OVER (PARTITION BY portfolio_id) AS INT) / 365e0 AS y, amount FROM flows),
ok AS (SELECT portfolio_id FROM flows GROUP BY 1 HAVING count(*) >= 2 AND max(date) - min(date) >= 90 AND bool_or(amount < 0) AND bool_or(amount > 0)),
ends AS (SELECT portfolio_id, sum(amount / pow(0.0001e0, y)) AS flo, sum(amount / pow(11e0, y)) AS fhi FROM d GROUP BY 1),
start AS (SELECT portfolio_id, flo FROM ends JOIN ok USING (portfolio_id) WHERE sign(flo) <> sign(fhi)),
bis AS (SELECT portfolio_id, 0 AS n, -0.9999e0 AS lo, 10e0 AS hi, sign(flo) AS s FROM start
  UNION ALL
  SELECT b.portfolio_id, any_value(b.n) + 1, CASE WHEN sign(sum(d.amount / pow(1 + (b.lo + b.hi) / 2, d.y))) = any_value(b.s) THEN any_value((b.lo + b.hi) / 2) ELSE any_value(b.lo) END,
         CASE WHEN sign(sum(d.amount / pow(1 + (b.lo + b.hi) / 2, d.y))) = any_value(b.s) THEN any_value(b.hi) ELSE any_value((b.lo + b.hi) / 2) END, any_value(b.s)
  FROM bis b JOIN d USING (portfolio_id) WHERE b.n < 45 GROUP BY b.portfolio_id)
SELECT p.portfolio_id, round((lo + hi) / 2, 6) AS xirr FROM (SELECT DISTINCT portfolio_id FROM flows) p LEFT JOIN (SELECT * FROM bis WHERE n = 45) USING (portfolio_id)"""

QUERIES_XIRR_FLOWS = """
WITH RECURSIVE flows AS (
  SELECT o_custkey % 100 AS portfolio_id, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN -o_totalprice / 0.9973e0 ELSE o_totalprice / 0.9973e0 END AS amount FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_custkey % 100, DATE '2001-12-31', sum(o_totalprice / 0.9973e0) / 2e0 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


@query("xirr", "", QUERIES_XIRR_FLOWS + _XIRR)
def _(spark, sf):
    c = A.cash_events(spark, sf).where(F.col("kind") != "INTEREST")
    closing = c.where(F.col("kind") == "DEPOSIT").groupBy("portfolio_id").agg((exact_sum("amount") / 2.0).alias("amount"))
    flows = c.select("portfolio_id", "date", (-F.col("amount")).alias("amount")).unionByName(
        closing.select("portfolio_id", F.lit("2001-12-31").cast("date").alias("date"), "amount")
    )
    return returns.xirr(flows).select("portfolio_id", *r6("xirr"))


def _periods(spark, sf) -> DataFrame:
    v = A.daily_values(spark, sf)
    return v.groupBy("portfolio_id").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.min_by("value", "date").alias("value_begin"), F.max_by("value", "date").alias("value_end"),
    )


@query("modified_dietz", "v_daily v_points", """
SELECT p.portfolio_id, CAST(p.days AS INT) AS days, round((p.v1 - p.v0 - coalesce(sum(f.amount), 0e0)) / (p.v0 + coalesce(sum(f.amount * greatest(least((p.days - (f.date - p.d0)) / p.days, 1e0), 0e0)), 0e0)), 6) AS dietz
FROM (SELECT portfolio_id, min(date) AS d0, max(date) - min(date) AS days, arg_min(value, date) AS v0, arg_max(value, date) AS v1 FROM v_daily GROUP BY 1) p
LEFT JOIN v_points f USING (portfolio_id) WHERE p.days > 0 GROUP BY p.portfolio_id, p.days, p.v0, p.v1, p.d0""")
def _(spark, sf):
    d = returns.modified_dietz(A.flow_points(spark, sf), _periods(spark, sf))
    return d.where(F.col("days") > 0).select("portfolio_id", "days", *r6("dietz"))


_TWR = """
, fl AS (SELECT f.portfolio_id, (SELECT min(v.date) FROM v_daily v WHERE v.portfolio_id = f.portfolio_id AND v.date >= f.date) AS date, amount FROM v_points f),
g AS (SELECT portfolio_id, date, sum(CASE WHEN amount > 0 THEN amount ELSE 0e0 END) AS i, sum(CASE WHEN amount < 0 THEN -amount ELSE 0e0 END) AS o FROM fl WHERE date IS NOT NULL GROUP BY 1, 2),
st AS (SELECT v.portfolio_id, v.date, v.value, coalesce(g.i, 0e0) AS i, coalesce(g.o, 0e0) AS o, lag(v.value) OVER (PARTITION BY v.portfolio_id ORDER BY v.date) AS prev
       FROM v_daily v LEFT JOIN g USING (portfolio_id, date)),
ix AS (SELECT portfolio_id, date, product(CASE WHEN prev IS NULL OR abs(prev + i) <= 1e-9 THEN 1e0 ELSE (value + o) / (prev + i) END) OVER (PARTITION BY portfolio_id ORDER BY date) * 100 AS idx FROM st)
"""


def _twr_sql(body: str) -> str:
    return sql("v_daily v_points", "") .rstrip() + _TWR + body


def _index(spark, sf) -> DataFrame:
    return returns.twr_index(A.daily_values(spark, sf), A.flow_points(spark, sf))


QUERIES["twr_index"] = lambda spark, sf: _index(spark, sf).select("portfolio_id", "date", *r6("index"))
ORACLES["twr_index"] = _twr_sql('SELECT portfolio_id, date, round(idx, 6) AS "index" FROM ix')

QUERIES["twr"] = lambda spark, sf: returns.twr(_index(spark, sf)).select("portfolio_id", "days", *r6("twr", "twr_annual", dp=8))
ORACLES["twr"] = _twr_sql("""
SELECT portfolio_id, CAST(max(date) - min(date) AS INT) AS days, round(CASE WHEN count(*) >= 2 THEN arg_max(idx, date) / 100 - 1 END, 8) AS twr,
       CASE WHEN max(date) - min(date) >= 365 THEN round(pow(arg_max(idx, date) / 100, 365e0 / (max(date) - min(date))) - 1, 8) END AS twr_annual FROM ix GROUP BY 1""")

_EPISODES = """
, pk AS (SELECT *, coalesce(idx >= max(idx) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top FROM ix),
rn AS (SELECT *, sum(CASE WHEN top THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY date) AS run FROM pk),
rs AS (SELECT portfolio_id, run, min(date) AS peak_date, arg_min(idx, date) AS peak, min(idx) FILTER (NOT top) AS low,
              arg_min(date, (idx, date)) FILTER (NOT top) AS trough_date FROM rn GROUP BY 1, 2),
ep AS (SELECT *, lead(peak_date) OVER (PARTITION BY portfolio_id ORDER BY run) AS recovery_date FROM rs)
"""

QUERIES["drawdown_episodes"] = lambda spark, sf: returns.drawdowns(_index(spark, sf)).select(
    "portfolio_id", "peak_date", "trough_date", *r6("depth"), "recovery_date", "duration_days", "ongoing"
)
ORACLES["drawdown_episodes"] = _twr_sql(_EPISODES + """
SELECT portfolio_id, peak_date, trough_date, round(low / peak - 1, 6) AS depth, recovery_date, CAST(recovery_date - peak_date AS INT) AS duration_days, recovery_date IS NULL AS ongoing
FROM ep WHERE low IS NOT NULL""")


def _max_dd(spark, sf):
    ix = _index(spark, sf)
    return returns.max_drawdown(returns.drawdowns(ix), ix).select("portfolio_id", *r6("depth"), "episodes", "longest_days")


QUERIES["max_drawdown"] = _max_dd
ORACLES["max_drawdown"] = _twr_sql(_EPISODES + """
SELECT portfolio_id, round(coalesce(min(low / peak - 1), 0e0), 6) AS depth, count(low) AS episodes,
       CAST(max(coalesce(recovery_date, fin) - peak_date) FILTER (low IS NOT NULL) AS INT) AS longest_days
FROM ep JOIN (SELECT portfolio_id, max(date) AS fin FROM ix GROUP BY 1) USING (portfolio_id) GROUP BY 1""")


# --- market data ----------------------------------------------------------------------------

@query("quote_gate", "", """
WITH RECURSIVE f AS (SELECT user_id AS instrument_key, event_id AS seq, value AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT instrument_key, seq, price, rn, true AS accepted, price AS state FROM f WHERE rn = 1
  UNION ALL
  SELECT f.instrument_key, f.seq, f.price, f.rn, abs(f.price / g.state - 1) <= 0.2e0, CASE WHEN abs(f.price / g.state - 1) <= 0.2e0 THEN f.price ELSE g.state END
  FROM g JOIN f ON f.instrument_key = g.instrument_key AND f.rn = g.rn + 1)
SELECT instrument_key, seq, round(price, 6) AS price, accepted, CASE WHEN NOT accepted THEN 'move too large' END AS reason FROM g""")
def _(spark, sf):
    return gate.gate_sequence(A.quotes_feed(spark, sf)).select("instrument_key", "seq", *r6("price"), "accepted", "reason")


@query("quote_gate_arrivals", "", """
WITH RECURSIVE e AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS own FROM events),
f AS (
  SELECT user_id AS k, event_id AS seq, (50e0 + value / 2) * CASE WHEN event_id % 41 = 0 THEN 100e0 WHEN event_id % 53 = 0 THEN -1e0 ELSE 1e0 END AS price,
         CASE WHEN event_id % 101 <> 0 THEN CAST(ts AS TIMESTAMP) END AS told, CASE WHEN event_id % 31 = 0 THEN 'CHF' WHEN event_id % 59 = 0 THEN '' ELSE own END AS cur,
         CASE WHEN user_id % 4 = 1 OR (user_id % 5 < 2 AND user_id % 2 = 0) THEN own END AS want, CASE WHEN user_id % 5 < 2 THEN 60e0 + user_id % 40 END AS close,
         CASE WHEN user_id % 5 < 2 AND user_id % 2 = 0 THEN own END AS close_cur, CASE WHEN user_id % 5 < 2 THEN TIMESTAMP '2024-01-15' END AS close_at,
         row_number() OVER (PARTITION BY user_id ORDER BY ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END, event_id) AS rn
  FROM e),
g AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, 0e0 AS price, '' AS reason, CAST(NULL AS DOUBLE) AS hp, CAST(NULL AS VARCHAR) AS hc, CAST(NULL AS TIMESTAMP) AS ht, CAST(NULL AS DOUBLE) AS before FROM f
  UNION ALL
  SELECT k, rn, seq, price, reason, CASE WHEN reason IS NULL THEN price ELSE coalesce(close, hp) END, CASE WHEN reason IS NULL THEN cur WHEN close IS NOT NULL THEN close_cur ELSE hc END,
         CASE WHEN reason IS NULL THEN told WHEN close IS NOT NULL THEN close_at ELSE ht END, hp
  FROM (SELECT f.*, g.hp, g.hc, g.ht,
               CASE WHEN f.price <= 0 THEN 'non-positive price' WHEN f.cur = '' THEN 'missing currency' WHEN f.cur <> f.want THEN 'unexpected currency' WHEN f.cur <> g.hc THEN 'currency changed'
                    WHEN f.told < g.ht THEN 'older than cached' WHEN abs(f.price / g.hp - 1) > 0.2e0 THEN 'move too large'
                    WHEN g.hp IS NULL AND abs(f.price / f.close - 1) > 0.5e0 THEN 'too far from statement' END AS reason
        FROM g JOIN f ON f.k = g.k AND f.rn = g.rn + 1))
SELECT k AS instrument_key, seq, round(price, 6) AS price, reason IS NULL AS accepted, reason, round(before, 6) AS prev_price FROM g WHERE rn > 0""")
def _(spark, sf):
    """All rules, quotes in order of arrival: late ones, other units and currencies, statements to go on from."""
    out = gate.gate_sequence(A.quote_arrivals(spark, sf), ["arrived_at", "seq"])
    return out.select("instrument_key", "seq", *r6("price"), "accepted", "reason", *r6("prev_price"))


@query("payment_frequency", "v_prof_rows", """
SELECT instrument_key, CAST(arg_min(f, round(abs(ln(f / (365.25e0 / gap))), 12)) AS INT) AS frequency FROM (
  SELECT instrument_key, median(gap) AS gap FROM (SELECT instrument_key, ex_date - lag(ex_date) OVER (PARTITION BY instrument_key ORDER BY ex_date) AS gap
    FROM (SELECT DISTINCT instrument_key, ex_date FROM v_prof_rows)) WHERE gap IS NOT NULL GROUP BY 1), (VALUES (1e0), (2e0), (4e0), (6e0), (12e0), (52e0)) x(f)
WHERE gap > 0 GROUP BY 1""")
def _(spark, sf):
    return quotes.payment_frequency(A.profile_rows(spark, sf), ["instrument_key"])


@query("dominant_currency", "v_dist", """
SELECT portfolio_id, currency FROM (SELECT portfolio_id, currency, row_number() OVER (PARTITION BY portfolio_id ORDER BY count(*) DESC, max(ex_date) DESC NULLS LAST, currency DESC) AS r
FROM v_dist GROUP BY 1, 2) WHERE r = 1""")
def _(spark, sf):
    return quotes.dominant_currency(A.distributions(spark, sf), ["portfolio_id"])


@query("dividend_profile", "v_prof_rows", """
SELECT instrument_key, any_value(currency) AS currency, round(sum(amount) FILTER (ex_date > DATE '2001-08-01' - 365 AND ex_date <= DATE '2001-08-01'), 6) AS ttm_per_share, count(*) AS payments
FROM v_prof_rows GROUP BY 1""")
def _(spark, sf):
    p = quotes.profile_from_rows(A.profile_rows(spark, sf), ["instrument_key"], A.AS_OF)
    return p.select("instrument_key", "currency", *r6("ttm_per_share"), "payments")


@query("price_unit", "", """
SELECT p_partkey, CASE WHEN abs(p_size * 100e0 / 25e0 / 100e0 - 1) <= 0.1e0 THEN 'minor' WHEN abs(p_size * 100e0 / 25e0 - 1) <= 0.1e0 THEN 'major' ELSE 'unknown' END AS unit FROM part""")
def _(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", quotes.price_unit(F.col("p_size") * 100.0, F.lit(25.0)).alias("unit"))


@query("source_health", "", """
WITH l AS (SELECT user_id AS source, value < 25 AS ok, event_type AS error, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT *, max(CASE WHEN ok THEN rn ELSE 0 END) OVER (PARTITION BY source) AS good, max(CASE WHEN NOT ok THEN rn ELSE 0 END) OVER (PARTITION BY source) AS bad FROM l),
a AS (SELECT source, count(*) FILTER (rn > good) AS n, CAST(max(ts) FILTER (rn = good) AS TIMESTAMP) AS last_success_at, max(error) FILTER (rn = bad) AS last_error, CAST(max(ts) FILTER (rn = bad) AS TIMESTAMP) AS last_error_at,
             count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures FROM s GROUP BY 1)
SELECT source, CASE WHEN n >= 3 THEN 'down' WHEN n > 0 THEN 'degraded' ELSE 'ok' END AS status, strftime(last_success_at, '%Y-%m-%d %H:%M:%S') AS last_success_at, last_error,
       strftime(last_error_at, '%Y-%m-%d %H:%M:%S') AS last_error_at, successes, failures, n AS consecutive_failures FROM a""")
def _(spark, sf):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    out = quotes.source_health(A.fetch_log(spark, sf))
    return out.select("source", "status", text("last_success_at"), "last_error", text("last_error_at"), "successes", "failures", "consecutive_failures")


@query("first_usable", "", """
WITH p AS (SELECT p_partkey AS k, p_retailprice AS close, 'P' || p_partkey AS p, 'Q' || p_partkey AS q FROM part),
i AS (
  SELECT *, k % 97 = 0 AS excluded, k % 11 = 0 AS overridden, k % 50 = 7 AS cash, CASE k % 4 WHEN 0 THEN 'AMS-' WHEN 2 THEN 'LON-' ELSE '' END AS venue,
         CASE WHEN k % 5 = 0 THEN [p || 'X'] ELSE [p] END || CASE WHEN k % 3 = 0 THEN [q] ELSE [] END || CASE WHEN k % 5 = 0 THEN [p] ELSE [] END AS tickers FROM p),
c AS (SELECT *, CASE WHEN excluded THEN [] WHEN overridden THEN ['SWX-' || p] WHEN cash THEN [] ELSE list_transform(tickers, lambda t: venue || t) END AS candidates FROM i),
landed AS (
  SELECT f[1] || k || f[2] AS symbol, k // (CAST(f[3] AS BIGINT) + 2) % 2 = 0 AS bad, close * CASE f[1] WHEN 'LON-P' THEN 100 ELSE 1 END AS price, CASE f[1] WHEN 'LON-P' THEN NULL ELSE 'EUR' END AS currency
  FROM p, (VALUES (['P', '', '0']), (['P', 'X', '1']), (['AMS-P', '', '2']), (['AMS-Q', '', '3']), (['Q', '', '4']), (['LON-P', '', '5']), (['SWX-P', '', '6'])) v(f)),
r AS (SELECT k, unnest(candidates) AS symbol, generate_subscripts(candidates, 1) AS rank FROM c),
t AS (SELECT r.*, bad, price, currency, bad IS NOT NULL AND NOT bad AS ok FROM r LEFT JOIN landed USING (symbol)),
b AS (SELECT k, min(rank) FILTER (ok) AS at_rank FROM t GROUP BY 1),
o AS (
  SELECT k, max(symbol) FILTER (rank = at_rank) AS candidate, max(price) FILTER (rank = at_rank) AS price, max(currency) FILTER (rank = at_rank) AS currency,
         string_agg(symbol || CASE WHEN bad THEN ': provider status' ELSE ': not landed' END, '; ' ORDER BY rank) FILTER (at_rank IS NULL OR rank < at_rank) AS misses FROM t JOIN b USING (k) GROUP BY 1),
w AS (
  SELECT c.k, coalesce(CASE WHEN k % 6 <> 0 THEN 'USD' END, CASE k % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END) AS want, candidate, price, currency, CASE WHEN k % 3 <> 1 THEN close END AS close,
         CASE WHEN excluded THEN 'excluded by user' WHEN len(candidates) = 0 THEN 'forex is priced from rates' ELSE coalesce(misses, '') END AS misses FROM c LEFT JOIN o USING (k))
SELECT k AS instrument_key, CASE WHEN want IS NOT NULL THEN candidate END AS candidate, round(CASE WHEN want IS NULL THEN NULL WHEN abs(price / close / 100 - 1) <= 0.1e0 THEN price / 100 ELSE price END, 6) AS price,
       CASE WHEN want IS NOT NULL AND candidate IS NOT NULL THEN coalesce(currency, want) END AS currency, CASE WHEN want IS NULL THEN 'unknown trade currency' ELSE misses END AS misses FROM w""")
def _(spark, sf):
    """Symbols to try per instrument, the first with a valid landed quote, in major units; what missed before it."""
    instruments, overrides = A.listed(spark, sf)
    known = quotes.expected_currency(instruments, overrides).join(instruments.select("portfolio_id", "instrument_key", "close_price").hint("merge"), ["portfolio_id", "instrument_key"])
    out = quotes.first_usable(quotes.symbol_candidates(instruments, overrides), A.landed_quotes(spark, sf), known)
    return out.select("instrument_key", "candidate", *r6("price"), "currency", F.concat_ws("; ", "misses").alias("misses"))


# --- streams --------------------------------------------------------------------------------

def _slices(spark: SparkSession, sf: str, name: str, time: str, n: int = 5) -> list[DataFrame]:
    """A table in `n` spans of time of equal length, earliest first; every row is in one of them."""
    rows = A.table(spark, sf, name)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return [rows]
    number = F.coalesce(F.least(F.lit(n - 1), F.floor((at - lo) / F.lit(max(1, hi - lo) / n))), F.lit(0))
    return [rows.where(number == i) for i in range(n)]


@query("stream_quote_gate", "", ORACLES["quote_gate"])
def _(spark, sf):
    def gated(events: DataFrame) -> DataFrame:
        return jobs.gate_quotes(
            events.select(
                F.col("user_id").alias("instrument_key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("as_of"),
                F.col("value").alias("price"), F.lit("USD").alias("currency"),
            )
        )

    out = jobs.drain_slices(_slices(spark, sf, "events", "ts"), gated, "gate")
    return out.select("instrument_key", "seq", *r6("price"), "accepted", "reason")


@query("stream_unique_events", "", "SELECT DISTINCT event_id AS id, user_id FROM events")
def _(spark, sf):
    def unique(events: DataFrame) -> DataFrame:
        e = events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("at"))
        return jobs.unique_events(e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), "at").select("id", "user_id")

    return jobs.drain_slices(_slices(spark, sf, "events", "ts"), unique, "unique")


@query("stream_running_income", "", """
SELECT o_custkey % 100 AS portfolio_id, strftime(o_orderdate, '%Y-%m') AS month, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS gross, count(*) AS payments FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    def income(orders: DataFrame) -> DataFrame:
        rows = orders.select(
            (F.col("o_custkey") % 100).alias("portfolio_id"), F.lit("USD").alias("currency"), F.col("o_orderdate").cast("date").alias("pay_date"),
            F.col("o_totalprice").alias("gross"), F.lit(0.0).alias("tax"),
        )
        return jobs.running_income(rows, "40 days")

    updates = jobs.drain_slices(_slices(spark, sf, "orders", "o_orderdate"), income, "income", "update")
    out = jobs.newest(updates, ["portfolio_id", "currency", "month"])
    return out.select("portfolio_id", F.date_format("month", "yyyy-MM").alias("month"), F.col("gross").cast("decimal(18,2)").alias("gross"), "payments")


# --- statements rendered from the tables and read back --------------------------------------

def _statement_files(spark: SparkSession, sf: str) -> DataFrame:
    """One statement per block of 500 order keys, so a file's size does not grow with the data."""
    li = A.table(spark, sf, "lineitem")
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    line = F.concat_ws(
        ",", F.lit("Trades,Data,Order,Stocks"), F.lit("USD"), F.concat(F.lit("T"), (F.col("l_partkey") % 20).cast("string")),
        F.concat(F.lit('"'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(', 00:00:00"')), q.cast("string"),
        (cents / F.lit(100)).cast("decimal(18,2)").cast("string"), F.lit("0,0"), F.lit("O"),
    )
    head = "Statement,Header,Field Name,Field Value\nStatement,Data,Period,2001\nAccount Information,Header,Field Name,Field Value\nAccount Information,Data,Base Currency,USD\n"
    cols = "Trades,Header,DataDiscriminator,Asset Category,Currency,Symbol,Date/Time,Quantity,T. Price,Proceeds,Comm/Fee,Code\n"
    block = F.floor(F.col("l_orderkey") / 500).cast("long")
    files = li.select(block.alias("block"), line.alias("line")).groupBy("block").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    return files.select(
        F.lit("default").alias("portfolio_id"), F.concat(F.lit("block"), F.col("block").cast("string")).alias("path"), F.concat(F.lit(head + cols), "lines").alias("text")
    )


def _statement_text(lines: DataFrame, made: F.Column) -> DataFrame:
    """Files (`batch`, `portfolio_id`, `path`, `text`) of trade lines: `batch`, `portfolio_id`, `path`, `line`; `made` is the time of the export."""
    head = F.concat(
        F.lit("Statement,Header,Field Name,Field Value\nStatement,Data,Period,2001\nStatement,Data,WhenGenerated,"), made,
        F.lit("\nAccount Information,Header,Field Name,Field Value\nAccount Information,Data,Base Currency,USD\n"),
        F.lit("Trades,Header,DataDiscriminator,Asset Category,Currency,Symbol,Date/Time,Quantity,T. Price,Proceeds,Comm/Fee,Code\n"),
    )
    files = lines.groupBy("batch", "portfolio_id", "path").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    return files.select("batch", "portfolio_id", "path", F.concat(head, "lines").alias("text"))


def _statement_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Five batches of statements of two portfolios, some of which overlap.

    A block of 500 order keys is a statement of batch block % 5; 250 keys of it and 250 of the
    next one are another statement, a batch later for every third block.
    """
    li = A.table(spark, sf, "lineitem")
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    line = F.concat_ws(
        ",", F.lit("Trades,Data,Order,Stocks"), F.lit("USD"), F.concat(F.lit("T"), (F.col("l_partkey") % 20).cast("string")),
        F.concat(F.lit('"'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(', 00:00:00"')), q.cast("string"),
        (cents / F.lit(100)).cast("decimal(18,2)").cast("string"), F.lit("0,0"), F.lit("O"),
    )
    block = F.floor(F.col("l_orderkey") / 500).cast("long")
    middle = F.floor((F.col("l_orderkey") - 250) / 500).cast("long")
    lines = li.select(line.alias("line"), F.explode(F.array(F.struct(block.alias("block"), F.lit("whole").alias("kind")), F.struct(middle.alias("block"), F.lit("across").alias("kind")))).alias("f"))
    lines = lines.select("line", "f.*").where("kind = 'whole' or (block >= 0 and block % 3 = 0)")
    late = F.when(F.col("kind") == "across", 1).otherwise(0)
    rows = lines.select(
        ((F.col("block") + late) % 5).alias("batch"), F.when(F.col("block") % 6 < 3, "north").otherwise("south").alias("portfolio_id"),
        F.concat("kind", F.lpad(F.col("block").cast("string"), 9, "0")).alias("path"), "line",
    )
    return _statement_text(rows, F.lit("\"2002-01-02, 10:00:00 EST\""))


#: The same statements in SQL: v_lines has a row per file and distinct fill with its number of copies.
_BATCHES_SQL = """
WITH f AS (
  SELECT CAST(floor(l_orderkey / 500) AS BIGINT) AS block, 'whole' AS kind, * FROM lineitem
  UNION ALL SELECT CAST(floor((l_orderkey - 250) / 500) AS BIGINT), 'across', * FROM lineitem WHERE l_orderkey >= 250 AND CAST(floor((l_orderkey - 250) / 500) AS BIGINT) % 3 = 0),
lines AS (
  SELECT (block + CASE kind WHEN 'across' THEN 1 ELSE 0 END) % 5 AS batch, CASE WHEN block % 6 < 3 THEN 'north' ELSE 'south' END AS portfolio_id, kind || lpad(CAST(block AS VARCHAR), 9, '0') AS path,
         'T' || CAST(l_partkey % 20 AS VARCHAR) AS instrument_key, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
         round(l_extendedprice, 2) AS price, count(*) AS n
  FROM f GROUP BY ALL)
"""


def _only_trades(files: DataFrame) -> dict[str, DataFrame]:
    """Raw files and fills of a batch; the statements made here have no other section."""
    tx = ingest.derive_transactions(files)
    heads = statements.identify(files).select("portfolio_id", "path", "file_id", "canonical_id")
    return {"raw_files": heads, "transactions": tx}


_STORES: dict[tuple[str, str], tuple[EventStore, DataFrame]] = {}


def _arriving(files: DataFrame, batch: int) -> DataFrame:
    """The files of a batch; those of the batch before come once more under other names."""
    again = files.where(F.col("batch") == batch - 1).withColumn("path", F.concat(F.lit("again-"), "path"))
    return files.where(F.col("batch") == batch).unionByName(again).drop("batch")


def _loaded(spark: SparkSession, sf: str) -> tuple[EventStore, DataFrame]:
    """(store, files) after all batches went through the stream, one after the other; loaded once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        files = scan.cut_lineage(_statement_batches(spark, sf))
        root, source, log = (jobs.scratch(spark, f"statements-{x}") for x in ("store", "in", "log"))
        store = EventStore.open(spark, root, portfolios=4, ids=4)
        for batch in range(5):
            new = _arriving(files, batch)
            new.write.mode("append").parquet(source)
            jobs.ingest_statements(spark.readStream.schema(new.schema).parquet(source), store, log, _only_trades).awaitTermination()
        _STORES[key] = store, files
    return _STORES[key]


def _fills(store: EventStore) -> DataFrame:
    """Distinct fills with the number of events, reports, and the file whose report counts for the first of them."""
    by = ["portfolio_id", "instrument_key", "date", "quantity", "price"]
    paths = store.table("raw_files").select("file_id", "path")
    rows = store.table("transactions").withColumn("price", F.round("price", 2)).join(paths, "file_id")
    at = F.when(F.col("first"), F.struct("batch", "imported_at", "path"))
    return rows.groupBy(*by).agg(F.count_if("first").alias("n"), F.count(F.lit(1)).alias("reports"), F.min(at)["path"].alias("first_path"))


@query("stream_ingest", "", _BATCHES_SQL + """
SELECT portfolio_id, instrument_key, date, quantity, price, max(n) AS n, CAST(sum(n) AS BIGINT) AS reports, arg_min(path, {'b': batch, 'p': path}) AS first_path FROM lines GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    """Statements arrive in five batches, with overlaps and repeated files; a batch already loaded is replayed at the end."""
    store, files = _loaded(spark, sf)
    store.load(_arriving(files, 3), 3, _only_trades)
    return _fills(store)


@query("statement_outcomes", "", _BATCHES_SQL + """
, seen AS (SELECT *, coalesce(max(n) OVER (PARTITION BY portfolio_id, instrument_key, date, quantity, price ORDER BY batch, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines),
loaded AS (SELECT batch, portfolio_id, path, CAST(sum(greatest(n - before, 0)) AS BIGINT) AS added, CAST(sum(least(n, before)) AS BIGINT) AS skipped FROM seen GROUP BY 1, 2, 3)
SELECT portfolio_id, path, CASE WHEN skipped > 0 THEN 'partial-overlap' ELSE 'imported' END AS outcome, added, skipped FROM loaded
UNION ALL SELECT portfolio_id, 'again-' || path, 'duplicate-exact', 0, 0 FROM loaded WHERE batch < 4
UNION ALL SELECT portfolio_id, 'made-anew-' || path, 'duplicate-regenerated', 0, 0 FROM loaded""")
def _(spark, sf):
    """What each file added, found stored already, or was left out as; at last all files exported anew come in."""
    store, files = _loaded(spark, sf)
    anew = files.withColumns({"path": F.concat(F.lit("made-anew-"), "path"), "text": F.replace("text", F.lit("2002-01-02, 10"), F.lit("2002-03-04, 11"))})
    store.load(anew.drop("batch"), 5, _only_trades)
    return store.table("outcomes").select("portfolio_id", "path", "outcome", "added", "skipped")


@query("statement_delete", "", _BATCHES_SQL + """
SELECT portfolio_id, instrument_key, date, quantity, price, max(n) AS n, CAST(sum(n) AS BIGINT) AS reports, arg_min(path, {'b': batch, 'p': path}) AS first_path
FROM lines WHERE NOT (path LIKE 'whole%' AND batch IN (0, 3)) GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    """From a compacted copy, the whole statements of the first and the fourth batch are taken out; what overlapping ones also report stays."""
    store, files = _loaded(spark, sf)
    copy = store.compact(jobs.scratch(spark, "statements-compact"))
    out = files.where("path like 'whole%' and batch in (0, 3)").select("portfolio_id", "path")
    copy.delete_files(copy.table("raw_files").join(out, ["portfolio_id", "path"], "left_semi"))
    return _fills(copy)


@query("stream_recompute", "", """
SELECT o_orderpriority || '/' || o_orderstatus AS portfolio_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * CASE o_orderstatus WHEN 'O' THEN 2 ELSE 1 END) AS DOUBLE) AS total, count(*) AS orders
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def _(spark, sf):
    """Totals per portfolio, kept up by a stream of changed portfolios: some lose all their rows, some have corrected amounts."""
    source, target, feed, log = (jobs.scratch(spark, f"recompute-{x}") for x in ("source", "target", "feed", "log"))
    orders = A.table(spark, sf, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("portfolio_id"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("amount")
    )

    def totals(t: dict[str, DataFrame]) -> DataFrame:
        return t["orders"].groupBy("portfolio_id").agg(F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("orders"))

    corrected = orders.where("o_orderstatus != 'P'").withColumn("amount", (F.col("amount") * F.when(F.col("o_orderstatus") == "O", 2).otherwise(1)).cast("decimal(18,2)"))
    for version, changed in ((orders, orders), (corrected, orders.where("o_orderstatus in ('O', 'P')"))):
        jobs.write_bucketed(version, source)
        changed.select("portfolio_id").distinct().write.mode("append").parquet(feed)
        changes = spark.readStream.schema("portfolio_id string").parquet(feed)
        jobs.recompute_stream(changes, lambda: {"orders": spark.read.parquet(source)}, totals, target, log).awaitTermination()
    return spark.read.parquet(target).drop("bucket")


@query("statement_trades", "", """
SELECT 'T' || CAST(l_partkey % 20 AS VARCHAR) AS instrument_key, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
       round(l_extendedprice, 2) AS price, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    """Parse, derive and count the fills of all statements; nothing is lost or doubled."""
    tx = ingest.derive_transactions(_statement_files(spark, sf))
    return tx.groupBy("instrument_key", "date", "quantity", F.round("price", 2).alias("price")).agg(F.count(F.lit(1)).alias("n"))


@query("statement_records", "", "SELECT CAST(floor(l_orderkey / 500) AS BIGINT) AS block, count(*) AS trades FROM lineitem GROUP BY 1")
def _(spark, sf):
    files = statements.identify(_statement_files(spark, sf))
    rows = statements.bind_headers(statements.records(files)).where((F.col("section") == "Trades") & (F.col("row_type") == "Data"))
    names = files.select("file_id", F.substring("path", 6, 20).cast("long").alias("block"))
    counted = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("trades"))
    return counted.join(names, "file_id").groupBy("block").agg(F.sum("trades").alias("trades"))


@query("occurrence_ids", "", """
SELECT k AS key, CAST(n AS BIGINT) AS copies, substr(sha256(concat(k, chr(30), '0')), 1, 20) AS first_id FROM (
  SELECT concat_ws(chr(31), 'cash', CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS k, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    """Numbered copies of equal rows; a much-repeated key is numbered in parallel."""
    li = A.table(spark, sf, "lineitem")
    key = F.concat_ws("\u001f", F.lit("cash"), F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = dedupe.number_copies(li.select(key.alias("key"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["key"])
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min_by("id", "ordinal").alias("first_id"))
