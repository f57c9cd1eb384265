import pytest
from helpers import d, rates
from pyspark.sql import functions as F

from ledgerspark.functions import calendar as cal
from ledgerspark.functions import numeric as N
from ledgerspark.operators import fx


def ev(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_rounding(spark):
    r = ev(spark, a=N.round_away(F.lit(1.005), 2), b=N.round_away(F.lit(-1.005), 2), c=N.round_away(F.lit(-0.001), 2), d=N.round_up6(F.lit(-0.0000005)))
    assert (r.a, r.b, r.c, r.d) == (1.01, -1.01, 0.0, 0.0) and str(r.c) == "0.0" and str(r.d) == "0.0"


def test_sums_and_ratios(spark):
    df = spark.createDataFrame([(1e16,), (1.0,), (-1e16,), (None,)], "x double")
    assert df.agg(N.exact_sum("x")).first()[0] == 1.0
    assert df.where("x is null").agg(N.exact_sum("x")).first()[0] is None and df.where("x is null").agg(N.sum_known("x")).first()[0] == 0.0
    assert df.agg(N.sum_all_or_null("x")).first()[0] is None
    nan = df.unionByName(spark.createDataFrame([(float("nan"),)], "x double")).agg(N.exact_sum("x")).first()[0]
    assert nan != nan
    r = ev(spark, a=N.ratio(F.lit(1.0), F.lit(0.0)), b=N.pct(F.lit(1.0), F.lit(4.0)), c=N.ratio(F.lit(float("inf")), F.lit(1.0)), d=N.clamp(F.lit(5.0), 0.0, 1.0))
    assert (r.a, r.b, r.c, r.d) == (None, 25.0, None, 1.0)


def test_calendar(spark):
    day = F.lit("2025-01-31").cast("date")
    r = ev(
        spark, am=cal.add_months(day, 1), bad=cal.iso_date(F.lit("")), bad2=cal.iso_date(F.lit("2025-13-01")), q=cal.quarter_key(day), mb=cal.months_between(F.lit("2024-12-31").cast("date"), F.lit("2025-02-01").cast("date")),
        db=cal.days_between(day, F.lit("2025-02-03").cast("date")), pe=cal.period_end(cal.period_start(day, "quarter"), "quarter"),
    )
    assert (r.am, r.bad, r.bad2, r.q, r.mb, r.db, r.pe) == (d("2025-02-28"), None, None, "2025-Q1", 2, 3, d("2025-03-31"))


@pytest.fixture(scope="module")
def book(spark):
    return rates(
        spark,
        [("EUR", "USD", "2025-06-12", 1.14), ("EUR", "USD", "2025-06-13", 1.15), ("EUR", "USD", "2025-06-16", 1.16), ("EUR", "GBP", "2025-06-13", 0.85), ("EUR", "JPY", "2025-06-13", 0.0), ("USD", "CAD", "2025-06-13", 100.0)],
    )


def look(spark, book, src, dst, day, **kw):
    asked = spark.createDataFrame([(src, dst, d(day))], "src string, dst string, day date")
    r = fx.with_rate(asked, "src", "dst", "day", fx.resolve_rates(book, [dst], **kw), rate_date="rate_date", via="via").first()
    return r.rate, r.rate_date, r.via


def test_backward_lookup(spark, book):
    assert look(spark, book, "EUR", "USD", "2025-06-14") == (1.15, d("2025-06-13"), None)
    assert look(spark, book, "EUR", "USD", "2025-06-11")[0] is None
    assert look(spark, book, "EUR", "USD", "2025-08-01")[0] is None
    assert look(spark, book, "EUR", "USD", "2025-08-01", max_stale=400)[0] == 1.16
    assert look(spark, book, "JPY", "EUR", "2025-06-13")[0] is None


def test_inverse_pivot_identity(spark, book):
    assert look(spark, book, "CAD", "USD", "2025-06-13")[0] == pytest.approx(0.01)
    rate, day, via = look(spark, book, "GBP", "USD", "2025-06-16")
    assert rate == pytest.approx(1.16 / 0.85) and day == d("2025-06-13") and via == "EUR"
    assert look(spark, book, "XXX", "XXX", "1990-01-01") == (1.0, d("1990-01-01"), None)


def test_merge_prefers_fetched(spark, book):
    stated = rates(spark, [("EUR", "USD", "2025-06-13", 9.0), ("EUR", "USD", "2025-01-01", 1.0)])
    got = {(r.base, r.quote, str(r.date)): r.rate for r in fx.merge_rates(book, stated).collect()}
    assert got[("EUR", "USD", "2025-06-13")] == 1.15 and got[("EUR", "USD", "2025-01-01")] == 1.0


def test_stated_rates_stay_in_their_portfolio(spark, book):
    stated = spark.createDataFrame(
        [("p", "EUR", "CHF", d("2025-06-13"), 0.9), ("p", "EUR", "USD", d("2025-06-13"), 9.0), ("q", "EUR", "CHF", d("2025-06-13"), 0.8), ("q", "CHF", "SEK", d("2025-06-13"), 10.0)],
        "portfolio_id string, base string, quote string, date date, rate double",
    )
    table = fx.resolve_rates(fx.merge_rates(book, stated), ["CHF", "USD", "SEK"])
    asked = spark.createDataFrame([(p, "EUR", q, d("2025-06-14")) for p in "pqr" for q in ("CHF", "USD", "SEK")], "portfolio_id string, src string, dst string, day date")
    got = {(r.portfolio_id, r.dst): (r.rate, r.via) for r in fx.with_rate(asked, "src", "dst", "day", table, via="via").collect()}
    assert got == {
        ("p", "CHF"): (0.9, None), ("q", "CHF"): (0.8, None), ("r", "CHF"): (None, None), ("p", "USD"): (1.15, None), ("q", "USD"): (1.15, None), ("r", "USD"): (1.15, None),
        ("p", "SEK"): (None, None), ("q", "SEK"): (8.0, "CHF"), ("r", "SEK"): (None, None),
    }
    nobody = fx.with_rate(asked.drop("portfolio_id"), "src", "dst", "day", table)
    assert nobody.where("dst = 'CHF' AND rate IS NOT NULL").count() == 0


def test_unsupported(spark):
    assert [r[0] for r in fx.unsupported_currencies(spark.createDataFrame([("usd",), ("XAU",)], "currency string")).collect()] == ["XAU"]
