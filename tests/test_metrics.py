import datetime as dt

import pytest
from helpers import d, one, rates, settings, tx
from pyspark.sql import functions as F

from ledgerspark.operators import forecast, fx, holdings, income, rank, returns
from ledgerspark.operators.scan import cut_lineage

DIST = "portfolio_id string, instrument_key string, isin string, id string, pay_date date, ex_date date, currency string, gross double, tax double, net double, per_share double, description string, div_type string"


def dist(spark, rows):
    out = []
    for i, r in enumerate(rows):
        r = {"key": "K", "isin": None, "ccy": "USD", "tax": 0.0, "ex": None, "ps": None, "type": "Ordinary Dividend"} | r
        out.append(("p", r["key"], r["isin"], f"{i:03d}", d(r["pay"]), d(r["ex"]) if r["ex"] else None, r["ccy"], float(r["gross"]), float(r["tax"]), float(r["gross"] - r["tax"]), r["ps"], "", r["type"]))
    return spark.createDataFrame(out, DIST)


def no_rates(spark, base="USD"):
    return fx.resolve_rates(rates(spark, [("EUR", "USD", "2025-06-20", 1.085)]), [base])


def build(spark, t, *, positions=None, quotes=None, overrides=None, base="USD", method="FIFO", book=None, as_of="2025-06-20", instruments=None):
    pos = spark.createDataFrame(positions or [], "portfolio_id string, account string, as_of date, instrument_key string, currency string, quantity double, close_price double, cost_basis double")
    quo = spark.createDataFrame(quotes or [], "portfolio_id string, instrument_key string, price double, currency string, as_of timestamp, source string")
    ovr = spark.createDataFrame(overrides or [], "portfolio_id string, instrument_key string, display_symbol string, manual_price double, manual_price_currency string, excluded boolean")
    ins = spark.createDataFrame(instruments or [], "portfolio_id string, instrument_key string, symbol string, name string, asset_category string, aliases array<string>, trade_currency string, div_currency string, multiplier double")
    return cut_lineage(holdings.build(t, pos, ins, quo, ovr, settings(spark, base, method), book or no_rates(spark, base), as_of=as_of))


@pytest.fixture(scope="module")
def book_of_cases(spark):
    """One portfolio with one instrument per case."""
    t = None
    for key, ccy in (("close", "USD"), ("quote", "USD"), ("hand", "USD"), ("gbp", "GBP"), ("option", "USD"), ("out", "USD")):
        part = tx(spark, [("2025-01-01", 10, 5)], key=key, currency=ccy)
        t = part if t is None else t.unionByName(part)
    t = t.unionByName(tx(spark, [("2025-01-01", 10, 5), ("2025-06-10", -3, 6)], key="off"))
    day = d("2025-05-31")
    pos = [("p", "A", day, k, "USD", 10.0, 6.0, 50.0) for k in ("close", "quote", "hand")]
    pos += [("p", "A", day, "snap", "USD", 4.0, 6.0, 20.0), ("p", "B", d("2025-05-30"), "snap", "USD", 1.0, 6.0, 5.0), ("p", "A", day, "off", "USD", 9.0, 6.0, 20.0)]
    quo = [("p", k, 7.0, "USD", dt.datetime(2025, 6, 1), "feed") for k in ("quote", "hand", "option")]
    ovr = [("p", "hand", None, 8.0, None, False), ("p", "out", None, 8.0, None, True)]
    ins = [("p", "option", "OPT", "Option", "Options", [], "USD", None, 100.0)]
    return build(spark, t, positions=pos, quotes=quo, overrides=ovr, instruments=ins)


def test_price_precedence(book_of_cases):
    h = {r.instrument_key: r for r in book_of_cases.collect()}
    got = [(h[k].price_source, h[k].market_value_base, h[k].unrealized_pnl_base, h[k].discrepancy) for k in ("close", "quote", "hand")]
    assert got == [("snapshot", 60, 10, False), ("quote", 70, 20, False), ("manual", 80, 30, False)]


def test_unknown_stays_unknown(book_of_cases):
    h = {r.instrument_key: r for r in book_of_cases.collect()}
    g = h["gbp"]
    assert g.market_value is None and g.cost_basis_base is None and g.unpriced and g.missing_fx and g.weight_pct is None
    assert h["option"].market_value is None and h["option"].unpriced
    assert h["out"].weight_pct is None and h["out"].market_value_base == 80


def test_snapshot_only_and_discrepancy(book_of_cases):
    h = {r.instrument_key: r for r in book_of_cases.collect()}
    assert (h["snap"].quantity, h["snap"].quantity_source, h["snap"].cost_basis) == (5, "snapshot", 25)
    assert (h["off"].check_ledger, h["off"].check_difference, h["off"].discrepancy) == (10, 1, True)


def test_totals_and_coverage(book_of_cases):
    t = holdings.totals(book_of_cases).first()
    assert (t.market_value_base, t.open_positions, t.cost_covered, t.value_covered, t.aggregates_comparable) == (60 + 70 + 80 + 30 + 42, 7, 6, 5, False)
    assert (t.unpriced, t.missing_fx, t.discrepancies) == (2, 1, 1)


@pytest.mark.parametrize("method", ["FIFO", "AVERAGE"])
def test_fx_gain_is_not_lost_on_sale(spark, method):
    book = fx.resolve_rates(rates(spark, [("EUR", "USD", "2025-01-01", 1.1), ("EUR", "USD", "2025-06-20", 1.2)]), ["EUR"])
    h = build(spark, tx(spark, [("2025-01-01", 10, 110), ("2025-06-20", -10, 110)]), base="EUR", method=method, book=book).first()
    assert h.realized_pnl == pytest.approx(0) and h.realized_pnl_base == pytest.approx(1100 / 1.2 - 1000)


def test_dense_months_and_quarters(spark):
    s = settings(spark)
    b = income.by_period(dist(spark, [{"pay": "2025-04-10", "gross": 60}, {"pay": "2025-10-10", "gross": 35}]), "month", s, no_rates(spark)).orderBy("start").collect()
    assert len(b) == 7 and b[3].gross == 0 and (b[0].period, b[6].amount) == ("2025-04", 35)
    q = income.by_period(dist(spark, [{"pay": "2025-04-10", "gross": 10}, {"pay": "2025-05-20", "gross": 20}, {"pay": "2026-01-30", "gross": 30}]), "quarter", s, no_rates(spark)).orderBy("start").collect()
    assert [(x.period, x.gross) for x in q] == [("2025-Q2", 30), ("2025-Q3", 0), ("2025-Q4", 0), ("2026-Q1", 30)]


def test_gross_and_tax_at_one_rate_and_irregular(spark):
    rows = dist(spark, [{"pay": "2025-06-20", "gross": 50, "tax": 7.5, "ccy": "EUR"}, {"pay": "2025-06-21", "gross": 9, "type": "Special Dividend"}, {"pay": "2025-06-22", "gross": 5, "ccy": "XXX"}])
    b = income.by_period(rows, "year", settings(spark), no_rates(spark), net=True).first()
    assert (b.gross, b.tax, b.amount, b["count"], b.missing_fx) == (pytest.approx(54.25), pytest.approx(8.1375), pytest.approx(54.25 - 8.1375), 1, 1)
    assert one(income.overview(rows), "irregular") == (1,)


def test_parts_sum_to_the_bar_and_isin_links(spark):
    rows = dist(spark, [{"pay": "2025-01-01", "gross": 1, "isin": "I"}, {"pay": "2025-01-02", "gross": 2, "key": None, "isin": "I"}, {"pay": "2025-01-03", "gross": 4, "key": None}])
    p = income.by_period_and_instrument(rows, "month", settings(spark), no_rates(spark))
    assert {r.group_key: r.amount for r in p.collect()} == {"K": 3, "__unknown": 4}
    m = {(r.level, r.group_key): r.amount for r in income.payments_matrix(rows, settings(spark), no_rates(spark)).collect()}
    assert m[("row", "K")] == 3 and m[("row", "(unmatched)")] == 4 and m[("grand", None)] == 7
    names = spark.createDataFrame([("p", "K", "KAY")], "portfolio_id string, instrument_key string, symbol string")
    assert {r.label for r in income.with_labels(p, names).collect()} == {"KAY", "Unattributed"}


def test_withholding_and_ttm(spark):
    rows = dist(spark, [{"pay": "2025-01-01", "ex": "2024-12-20", "gross": 100, "tax": 15, "ps": 0.5}, {"pay": "2025-02-01", "ex": "2023-12-20", "gross": 100, "tax": 0, "ps": 0.7}])
    assert one(income.withholding(rows, ["instrument_key"]), "withholding_rate") == (0.075,)
    assert one(income.ttm_from_statements(rows, "2025-06-01"), "ttm_per_share", "payments") == (0.5, 1)


PROFILE_ROWS = "portfolio_id string, instrument_key string, ex_date date, pay_date date, amount double, currency string, declared boolean"
ACCRUALS = "portfolio_id string, instrument_key string, ex_date date, pay_date date, currency string, quantity double, gross_rate double, gross double, tax double, net double, open boolean"


def project(spark, accruals=(), rows=None):
    h = spark.createDataFrame([("p", "K", 100.0, "USD", "USD", None, False)], "portfolio_id string, instrument_key string, quantity double, currency string, trade_currency string, div_currency string, excluded boolean")
    rows = rows or [("p", "K", d("2024-12-10"), d("2024-12-20"), 0.4, "USD", True), ("p", "K", d("2025-06-10"), d("2025-06-20"), 0.6, "USD", True)]
    pr = spark.createDataFrame(rows, PROFILE_ROWS)
    profiles = spark.createDataFrame([("p", "K", "USD", True)], "portfolio_id string, instrument_key string, currency string, is_distributing boolean")
    items = cut_lineage(forecast.items(h, spark.createDataFrame(list(accruals), ACCRUALS), profiles, pr, settings(spark), no_rates(spark), "2025-07-15"))
    return h, profiles, pr, items


def test_forecast_is_seasonal(spark):
    _, _, _, items = project(spark)
    m = {r.month: r.gross_base for r in forecast.months(items, settings(spark), "2025-07-15").collect()}
    assert len(m) == 12 and m["2025-12"] == pytest.approx(40) and m["2026-06"] == pytest.approx(60) and sum(m.values()) == pytest.approx(100)


def test_declared_wins_over_estimate(spark):
    _, _, _, items = project(spark, [("p", "K", d("2025-12-10"), d("2025-12-20"), "USD", 100.0, 0.42, 42.0, 0.0, 42.0, True)])
    m = {r.month: r.gross_base for r in forecast.months(items, settings(spark), "2025-07-15").collect()}
    assert m["2025-12"] == 42 and m["2026-06"] == pytest.approx(60)
    # same ex month, other pay month: still one payment
    _, _, _, items = project(spark, [("p", "K", d("2025-12-30"), d("2026-01-05"), "USD", 100.0, 0.95, 95.0, 0.0, 95.0, True)])
    assert {r.month: r.gross_base for r in items.collect()} == {"2026-01": 95.0, "2026-06": pytest.approx(60)}


def test_forecast_coverage_and_stale_history(spark):
    h, profiles, pr, items = project(spark, rows=[("p", "K", d("2022-12-10"), d("2023-01-20"), 1.0, "USD", True)])
    s = forecast.seasonality(pr, "2025-07-15")
    assert one(s, "ex_month", "lag_months", "stale") == (12, 1, True)
    assert one(forecast.coverage(h, profiles, s, items), "coverage", "stale") == ("estimated", True)
    assert [r.month for r in items.collect()] == ["2026-01"]


def flows(spark, *rows):
    return spark.createDataFrame([("p", d(day), float(a)) for day, a in rows], "portfolio_id string, date date, amount double")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("2024-01-01", -1000), ("2024-12-31", 1100)], 0.1), ([("2024-01-01", -1000), ("2024-01-04", 1100)], None), ([("2024-01-01", -1000), ("2025-01-01", -5)], None),
        ([("2023-01-01", -500), ("2023-01-01", -500), ("2024-01-01", 1050)], 0.05),
    ],
)
def test_xirr(spark, rows, want):
    got = returns.xirr(flows(spark, *rows)).first().xirr
    assert got is None if want is None else got == pytest.approx(want, abs=1e-6)


def test_xirr_near_total_loss(spark):
    assert -0.9999 <= returns.xirr(flows(spark, ("2024-01-01", -1000), ("2025-01-01", 1))).first().xirr < -0.99


def test_period_flows_and_dietz(spark):
    per = spark.createDataFrame([("p", d("2024-01-01"), d("2024-12-31"), 10000.0, 11500.0, 365)], "portfolio_id string, start date, end date, value_start double, value_end double, days int")
    got = sorted((str(r.date), r.amount) for r in returns.period_flows(flows(spark, ("2024-06-01", 1000), ("2026-01-01", 5)), per).collect())
    assert got == [("2024-01-01", -10000.0), ("2024-06-01", -1000.0), ("2024-12-31", 11500.0)]
    per = per.select("portfolio_id", "start", "days", F.col("value_start").alias("value_begin"), "value_end")
    r = returns.modified_dietz(flows(spark, ("2024-06-01", 1000)), per, with_start=False).first()
    assert r.dietz == pytest.approx(500 / 10500) and r.dietz_annual == pytest.approx(500 / 10500)


def values(spark, *rows):
    return spark.createDataFrame([("p", d(day), float(v)) for day, v in rows], "portfolio_id string, date date, value double")


def test_twr(spark):
    ix = returns.twr_index(values(spark, ("2024-01-01", 100), ("2024-01-02", 110), ("2024-01-03", 99)), flows(spark))
    assert returns.twr(ix).first().twr == pytest.approx(-0.01) and ix.orderBy("date").collect()[-1]["index"] == pytest.approx(99)
    # an inflow on a day without valuation counts on the next one
    ix = returns.twr_index(values(spark, ("2024-01-05", 100), ("2024-01-08", 150)), flows(spark, ("2024-01-06", 50), ("2024-02-01", 9)))
    assert returns.twr(ix).first().twr == pytest.approx(0)
    ix = returns.twr_index(values(spark, ("2024-01-01", 100), ("2024-01-02", 0), ("2024-01-03", 500)), flows(spark))
    assert [r.restart for r in ix.orderBy("date").collect()] == [False, False, True]


def test_drawdown(spark):
    days = ["2025-01-01", "2025-02-01", "2025-03-01", "2025-04-01", "2025-05-01", "2025-06-01"]
    ix = spark.createDataFrame([("p", d(x), float(v)) for x, v in zip(days, [100, 120, 90, 110, 125, 115])], "portfolio_id string, date date, index double")
    e = returns.drawdowns(ix).orderBy("peak_date").collect()
    assert [(x.depth, str(x.recovery_date), x.duration_days, x.ongoing) for x in e] == [(-0.25, "2025-05-01", 89, False), (pytest.approx(-0.08), "None", None, True)]
    assert one(returns.max_drawdown(returns.drawdowns(ix), ix), "depth", "episodes", "longest_days") == (-0.25, 2, 89)


def test_fold_and_orders(spark):
    df = spark.createDataFrame([("p", "m", k, float(v)) for k, v in zip("abcd", [5, 4, 3, 2])], "portfolio_id string, bucket string, key string, value double")
    got = {r.key: r.value for r in rank.fold_other(df, ["portfolio_id"], ["bucket"], "key", "value", 2).collect()}
    assert got == {"a": 5, "b": 4, "__other": 5}
    got = {r.key: r.value for r in rank.fold_other(df, ["portfolio_id"], ["bucket"], "key", "value", 2, order=["zz", "d"]).collect()}
    assert got == {"d": 2, "a": 5, "__other": 7}
    rows = spark.createDataFrame([("x", None), ("y", 1.0), ("z", 2.0)], "symbol string, v double")
    assert [r.symbol for r in rank.user_order(rows, "v").collect()] == ["y", "z", "x"] and [r.symbol for r in rank.user_order(rows, "v", descending=True).collect()] == ["z", "y", "x"]
