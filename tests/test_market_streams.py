import datetime as dt
import json
import random

import pytest
from helpers import d
from pyspark.sql import functions as F

from ledgerspark.functions import coerce
from ledgerspark.operators import dedupe, gate, quotes
from ledgerspark.sources import market, tables
from ledgerspark.streaming import jobs


def bodies(spark, *items):
    return spark.createDataFrame([(str(i), json.dumps(b)) for i, b in enumerate(items)], "instrument_key string, body string")


def test_coercions(spark):
    r = spark.range(1).select(
        coerce.as_number(F.lit("3,334.5")).alias("n"), coerce.as_number(F.lit("--")).alias("n0"), coerce.as_iso_date(F.lit("7/4/2025")).alias("us"),
        coerce.as_iso_date(F.lit("1751587200")).alias("s"), coerce.as_iso_date(F.lit("1751587200000")).alias("ms"), coerce.as_iso_date(F.lit("soon")).alias("bad"),
        coerce.as_currency(F.lit("eur")).alias("c"), coerce.as_boolean(F.lit("No")).alias("b"),
    ).first()
    assert tuple(r) == (3334.5, None, d("2025-07-04"), d("2025-07-04"), d("2025-07-04"), None, "EUR", False)


def test_rates(spark):
    ranged = market.fx_range(bodies(spark, {"base": "EUR", "rates": {"2025-01-02": {"USD": 1.1, "BAD1": 2, "GBP": -1}, "nope": {"USD": 1}}}, {}))
    assert [tuple(r) for r in ranged.collect()] == [("EUR", "USD", d("2025-01-02"), 1.1)]
    snap = market.fx_snapshot(bodies(spark, {"base": "EUR", "date": "2025-01-02", "amount": 10, "rates": {"USD": 11.0}}))
    assert [tuple(r) for r in snap.collect()] == [("EUR", "USD", d("2025-01-02"), 1.1)]


def test_quote_bodies(spark):
    df = bodies(spark, {"status": 200, "data": {"p": "1,234.5", "cl": 0, "u": "2025-01-02 10:00:00"}}, {"status": 404}, {"status": 200, "data": {"p": -1}}, {}, {"status": 200, "data": {"p": 5, "u": "2031-01-01"}})
    got = market.quotes(df.withColumn("loaded_at", F.lit("2025-01-03").cast("timestamp"))).orderBy("instrument_key").collect()
    assert [(r.price, r.reason) for r in got] == [(1234.5, None), (None, "provider status"), (None, "non-positive price"), (None, "no status"), (5.0, None)]
    assert got[0].previous_close is None and got[4].as_of == dt.datetime(2025, 1, 3)


def test_dividend_bodies(spark):
    df = bodies(spark, {"status": 200, "data": {"rows": [{"ex": "2025-01-02", "dps": "0.5", "cur": "eur"}, {"dt": "2025-02-02", "amount": 0}]}}, {"status": 200, "data": {"what": 1}}).withColumn("fallback_currency", F.lit("USD"))
    good, bad = market.dividends(df)
    assert [(r.instrument_key, r.ex_date, r.amount, r.currency) for r in good.collect()] == [("0", d("2025-01-02"), 0.5, "EUR")]
    assert [(r.instrument_key, r.reason) for r in bad.collect()] == [("1", "no row array")]


def test_fund_bodies(spark):
    pays = {"2024": [{"ex_date": "2024-06-01", "total_in_tc": 1.0, "total_in_eur": 1.2, "total_in_usd": 1.0, "total_in_gbp": 0.8}, {"ex_date": "2024-09-01", "total_in_eur": 1.3, "total_in_usd": 1.1}]}
    fund = {"results": [{"distribution_policy": "Ausschüttend", "distribution_frequency_months": pays, "distribution_cagr": {"year_5": 2.5, "x": "-"},
                         "distribution_frequency": [{"name": "jährlich", "start_date": "2020-01-01"}, {"name": "Vierteljaehrlich", "start_date": "2023-01-01"}, {"name": "monatlich", "start_date": "2030-01-01"}]}]}
    profiles, rows, rejects = market.fund_details(bodies(spark, fund, {"data": {"is_distributing": False, "distribution_frequency_months": pays}}, {"x": 1}), "2025-01-01")
    got = {r.instrument_key: (r.is_distributing, r.declared_frequency, r.cagr) for r in profiles.collect()}
    assert got == {"0": (True, 4, {"5": 2.5}), "1": (False, 0, None)}
    assert sorted((r.instrument_key, str(r.ex_date), r.amount, r.currency) for r in rows.collect()) == [("0", "2024-06-01", 1.0, "USD"), ("0", "2024-09-01", 1.1, "USD")]
    assert [r.instrument_key for r in rejects.collect()] == ["2"]


def feed(spark, n=300, keys=3):
    rnd = random.Random(3)
    rows = [(f"k{i % keys}", i, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i), rnd.choice([10, 11, 12, 14, 100, -1]) * rnd.uniform(0.9, 1.1), "USD") for i in range(n)]
    return rows, spark.createDataFrame(rows, "instrument_key string, seq long, as_of timestamp, price double, currency string")


def expected(rows):
    held, out = {}, {}
    for k, i, _, p, _ in rows:
        ok = p > 0 and (k not in held or abs(p / held[k] - 1) <= 0.2)
        held[k] = p if ok else held.get(k, None)
        if held[k] is None:
            del held[k]
        out[i] = ok
    return out


@pytest.mark.parametrize("kw", [{}, {"block_rows": 7}, {"block_rows": 7, "hot_rows": 20, "chunk_rows": 10}])
def test_gate_in_blocks_equals_one_pass(spark, kw):
    rows, df = feed(spark)
    got = {r.seq: r.accepted for r in gate.gate_sequence(df, **kw).collect()}
    assert got == expected(rows)


def test_stream_gate_goes_on_from_the_statement(spark):
    at = lambda i: dt.datetime(2025, 1, 2, i)
    rows = [("a", 1, at(1), 1000.0, "GBX"), ("a", 2, at(2), 10.1, "GBP"), ("a", 3, at(3), 10.2, "GBP"), ("a", 4, at(4), 20.0, "GBP"), ("a", 5, at(5), 10.3, "GBP")]
    quotes_ = spark.createDataFrame(rows, "instrument_key string, seq long, as_of timestamp, price double, currency string")
    stated = quotes_.withColumns({"statement_price": F.lit(10.0), "statement_currency": F.lit("GBP"), "statement_as_of": F.lit("2025-01-01").cast("timestamp")})
    slices = [stated.where("seq <= 1"), stated.where("seq in (2, 3)"), stated.where("seq > 3")]
    for parts in ([stated], slices):
        got = jobs.drain_slices(parts, lambda s: jobs.gate_quotes(s, "string"), "gate")
        assert [r.reason for r in got.orderBy("seq").collect()] == ["unexpected currency", None, None, "move too large", None]


def test_single_quote_rules(spark):
    cols = "price double, currency string, as_of timestamp, expected_currency string, close_price double, prev_price double, prev_currency string, prev_as_of timestamp"
    t = dt.datetime(2025, 1, 2)
    rows = [(10.0, "USD", t, "USD", None, 9.0, "USD", t), (20.0, "USD", t, "USD", None, 9.0, "USD", t), (10.0, "EUR", t, "USD", None, None, None, None), (10.0, "USD", t, None, 5.0, None, None, None),
            (10.0, "USD", t, None, None, 10.0, "USD", dt.datetime(2025, 1, 3))]
    got = [r[0] for r in spark.createDataFrame(rows, cols).select(quotes.check_quote()).collect()]
    assert got == [None, "move too large", "unexpected currency", "too far from statement", "older than cached"]


def test_symbols(spark):
    inst = spark.createDataFrame(
        [("p", "a", "FOND", ["FONDd"], "AEB", "Stocks"), ("p", "b", "BRK B", [], "NYSE", "Stocks"), ("p", "c", "ODD", [], "MOON", "Stocks"), ("p", "d", "X", [], "AEB", "Stocks")],
        "portfolio_id string, instrument_key string, symbol string, aliases array<string>, listing_exchange string, asset_category string",
    )
    ovr = spark.createDataFrame([("p", "d", "lon-xyz", False)], "portfolio_id string, instrument_key string, provider_symbol string, excluded boolean")
    got = [(r.instrument_key, r["rank"], r.candidate, r.confidence, r.path) for r in quotes.symbol_candidates(inst, ovr).orderBy("instrument_key", "rank").collect()]
    assert got == [("a", 1, "AMS-FOND", "high", "q"), ("a", 2, "AMS-FONDD", "high", "q"), ("b", 1, "BRK.B", "high", "s"), ("c", 1, "ODD", "low", "s"), ("d", 1, "LON-XYZ", "high", "q")]


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([("a", 1)] * 25 + [("a", 2)] * 3 + [("b", 1)], "key string, x int")
    got = dedupe.number_copies(df, ["key"], expand_rows=4).collect()
    assert sorted(r.ordinal for r in got if r.key == "a") == list(range(28)) and len({r.id for r in got}) == 29
    assert len(dedupe.number_copies(df.select("key"), ["key"], expand_rows=4).select("id").distinct().collect()) == 29


def test_restore(spark):
    old = spark.createDataFrame([("p", "USD"), ("q", "EUR")], "portfolio_id string, base_currency string")
    new = spark.createDataFrame([("p", "CHF")], "portfolio_id string, base_currency string")
    merged = tables.restore({"settings": new}, {"settings": old})["settings"]
    assert sorted(tuple(r) for r in merged.collect()) == [("p", "CHF"), ("q", "EUR")]
    assert tables.restore({"settings": new}, {"settings": old}, replace=True)["settings"].count() == 1
    assert tables.clear({"quotes": old, "raw_rows": old}, tables.MARKET)["quotes"].count() == 0


def test_affected_buckets_only(spark, tmp_path):
    t = spark.createDataFrame([(i, float(i)) for i in range(40)], "portfolio_id long, v double")
    add = lambda n: lambda x: x["t"].withColumn("v", F.col("v") + n)
    target = str(tmp_path / "gold")
    jobs.recompute_affected(t, {"t": t}, add(100), target)
    jobs.recompute_affected(t.where("portfolio_id = 3"), {"t": t}, add(200), target)
    got = {r.portfolio_id: r.v for r in spark.read.parquet(target).collect()}
    assert len(got) == 40 and got[3] == 203.0 and sum(v - k == 200 for k, v in got.items()) < 10
