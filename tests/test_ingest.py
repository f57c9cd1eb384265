import datetime as dt

import pytest
from pyspark.sql import functions as F
from sample_statements import january, quarter

from ledgerspark.functions import text as T
from ledgerspark.operators import derive
from ledgerspark.plans import ingest
from ledgerspark.sources import statements


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("statements")
    for name, text in {
        "1_january.csv": january(), "2_quarter.csv": quarter(), "3_copy.csv": quarter(), "4_again.csv": quarter("2025-05-05, 10:00:00").replace("\n", "\r\n"),
    }.items():
        (d / name).write_bytes(text.encode("utf-8"))
    return str(d)


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return ingest.load_directory(spark, folder)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_duplicate_files(spark, folder):
    files = statements.scan(spark, folder)
    fresh, outcome = ingest.new_files(files, None)
    got = {r.path.split("/")[-1]: r.outcome for r in outcome.collect()}
    assert got == {"1_january.csv": "new", "2_quarter.csv": "new", "3_copy.csv": "duplicate-exact", "4_again.csv": "duplicate-regenerated"}
    fresh, outcome = ingest.new_files(files, statements.identify(files).where(F.col("path").contains("2_")))
    got = {r.path.split("/")[-1]: r.outcome for r in outcome.collect()}
    assert got["2_quarter.csv"] == "duplicate-exact" and got["4_again.csv"] == "duplicate-regenerated" and fresh.count() == 1


def test_one_text_in_two_portfolios(spark):
    files = spark.createDataFrame([("p1", "a", quarter()), ("p2", "b", quarter())], "portfolio_id string, path string, text string")
    fresh, outcome = ingest.new_files(files, None)
    assert sorted(r.outcome for r in outcome.collect()) == ["new", "new"]
    tx = ingest.derive_transactions(fresh)
    got = {p: sorted(rows(tx.where(F.col("portfolio_id") == p), "line_no", "quantity", "price")) for p in ("p1", "p2")}
    assert got["p1"] and got["p1"] == got["p2"]


def test_records(spark):
    text = "﻿A,Header,x,,x\r\nA,Data,\"1,5\",\"q\"\"q\",\"two\nlines\"\r\rA,Data,1,2,3,4, \n\n,,\nA,Data,un\"quo\"ted\n"
    files = spark.createDataFrame([("p", "f", text)], "portfolio_id string, path string, text string").withColumn("file_id", F.lit("f"))
    r = statements.bind_headers(statements.records(files)).orderBy("line_no").collect()
    assert [x.line_no for x in r] == [1, 2, 5, 7, 8]
    assert r[1].fields == ["A", "Data", "1,5", 'q"q', "two\nlines"]
    assert r[2].fields == ["A", "Data", "1", "2", "3", "4", " "]
    assert r[3].fields == ["", "", ""] and r[4].fields == ["A", "Data", "unquoted"]
    m = statements.bind_headers(statements.records(files)).where("line_no = 5").select(statements.bound_map(F.col("header"), F.col("fields")).alias("m")).first().m
    assert m == {"x": "1", "__col3": "2", "x (2)": "3", "__col5": "4", "__col6": " "}


def test_header_facts(loaded):
    b, _ = loaded
    r = {x.period_end: x for x in b.raw_files.collect()}
    q = r[dt.date(2025, 3, 31)]
    assert (q.account, q.base_currency, q.broker, q.period_start) == ("N7000001", "USD", "Northwind Brokerage", dt.date(2025, 1, 1))
    assert r[dt.date(2025, 1, 31)].period_start == dt.date(2025, 1, 1)


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024", ("2024-01-01", "2024-12-31")), ("December 11, 2024", ("2024-12-11", "2024-12-11")), ("11-Dec-24", ("2024-12-11", "2024-12-11")),
        ("February 2024", ("2024-02-01", "2024-02-29")), ("2025-01-01 – 2025-02-03", ("2025-01-01", "2025-02-03")), ("01/02/2025", None), ("Smarch 2024", None),
    ],
)
def test_period(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(T.period("t").alias("p")).first().p
    assert (None if r is None else (str(r.start), str(r.end))) == want


def test_canon(spark):
    cells = ["3,334.3400", "50.0", " ", "--", "-0", "2025-07-14, 07:37:45", "2025-07-14", "a  b", "0.000000001", "1,5"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(T.canon("c")).collect()]
    assert got == ["3334.34", "50", "", "", "0", "2025-07-14T07:37:45", "2025-07-14", "a b", "0.000000001", "1,5"]


def test_transactions(loaded):
    b, led = loaded
    got = sorted(rows(led.transactions, "instrument_key", "quantity", "price", "fees", "files"))
    assert got == [
        ("700001", 120.0, 20.0, 12.0, 1), ("700002", -10.0, 1050.0, 5.0, 1), ("700002", 20.0, 1000.0, 5.0, 2), ("700002", 20.0, 1000.0, 5.0, 2),
    ]
    counts = {r.file_id: (r.added, r.skipped) for r in ingest.load_counts(b.transactions, led.transactions).collect()}
    assert sorted(counts.values()) == [(0, 2), (0, 4)]


def test_instruments(loaded):
    _, led = loaded
    r = {x.instrument_key: x for x in led.instruments.collect()}
    assert set(r) == {"700001", "700002"}
    assert r["700001"].symbol == "FOND" and r["700001"].aliases == ["FOND", "FONDd"] and r["700001"].isin == "LU0000000017"
    assert r["700001"].name == 'EURO "CORE" FUND, DIST\n(second line)'
    assert r["700001"].trade_currency == "EUR" and r["700002"].first_seen == dt.date(2025, 1, 7)


def test_distributions(loaded):
    _, led = loaded
    got = sorted(rows(led.distributions, "instrument_key", "per_share", "gross", "tax", "net", F.col("ex_date").cast("string"), "div_type"))
    assert got == [
        ("700001", 0.5, 60.0, 9.0, 51.0, "2025-03-06", "Ordinary Dividend"), ("700002", 1.0, 30.0, 0.0, 30.0, None, "Ordinary Dividend"),
        ("700002", 2.0, 60.0, 9.0, 51.0, None, "Special Dividend"),
    ]


def test_cash(loaded):
    _, led = loaded
    got = sorted(rows(led.cash_events, "kind", "amount", "currency"))
    assert got == [
        ("DEPOSIT", 50000.0, "USD"), ("FEE", -2.0, "USD"), ("FX", -2750.0, "USD"), ("INTEREST", 2.0, "USD"), ("TAX", -0.4, "USD"), ("WITHDRAWAL", -500.0, "USD"),
    ]


def test_accruals(loaded):
    _, led = loaded
    got = sorted(rows(led.accruals, F.col("ex_date").cast("string"), "net", "open", "quantity"))
    assert got == [("2025-03-06", 0.0, False, 120.0), ("2025-03-29", 30.0, True, 120.0)]


def test_accrual_reversal_in_a_later_file(spark):
    one = [("p", "f1", 1, "i1", "f1:1", "K", "EUR", 0.5, "0.5", 100.0, 0.0, 50.0, 50.0, "Po")]
    two = one[:0] + [("p", "f2", 1, "i1", "f2:1", "K", "EUR", 0.5, "0.5", 100.0, 0.0, 50.0, 50.0, "Po"), ("p", "f2", 2, "i2", "f2:2", "K", "EUR", 0.5, "0.5", 100.0, 0.0, -50.0, -50.0, "Re")]
    schema = "portfolio_id string, file_id string, line_no int, id string, row_id string, instrument_key string, currency string, gross_rate double, rate_text string, quantity double, tax double, gross double, net double, codes string"
    df = spark.createDataFrame(one + two, schema).withColumns({"ex_date": F.lit("2025-01-01").cast("date"), "pay_date": F.lit("2025-01-10").cast("date")})
    imported = spark.createDataFrame([("f1", "1"), ("f2", "2")], "file_id string, imported_at string")
    assert rows(ingest.merge_accruals(df, imported), "net", "open") == [(0.0, False)]
    assert rows(ingest.merge_accruals(df, imported, parity=True), "net", "open") == [(50.0, True)]


def test_positions_and_recovered_rate(loaded):
    _, led = loaded
    got = sorted(rows(led.positions, "instrument_key", "account", F.col("as_of").cast("string"), "quantity", "value"))
    assert got == [("700001", "N7000001", "2025-03-31", 120.0, 2520.0), ("700002", "N7000001", "2025-03-31", 30.0, 33000.0)]
    (base, quote, day, rate) = rows(led.fx_rates, "base", "quote", F.col("date").cast("string"), F.round("rate", 9))[0]
    assert (base, quote, day) == ("USD", "EUR", "2025-03-31") and rate == pytest.approx(1 / 1.1)


def test_reconciliation_all_ok(loaded):
    b, _ = loaded
    checks = b.reconciliation.collect()
    assert [c for c in checks if not c.ok] == []
    labels = {c.label for c in checks}
    for want in (
        "Open Positions value (EUR)", "Open Positions value (USD)", "Open Positions cost basis (USD)", "Dividends (EUR)", "Dividends (USD)", "Withholding tax (EUR)",
        "Withholding tax (USD)", "Deposits & Withdrawals (USD)", "Deposits & Withdrawals — statement total", "Interest (USD)", "Dividend accrual change (EUR)",
        "Open dividend accruals (EUR)", "Trades quantity 700002 (Stocks/USD)", "Trades realized P/L 700001 (Stocks/EUR)",
    ):
        assert want in labels, want


def test_reconciliation_can_fail(spark):
    text = quarter().replace("Interest,Data,USD,2025-03-05,USD Credit Interest,2", "Interest,Data,USD,2025-03-05,USD Credit Interest,3")
    files = spark.createDataFrame([("p", "x.csv", text)], "portfolio_id string, path string, text string")
    bad = [c.label for c in ingest.derive_files(files).reconciliation.where("not ok").collect()]
    assert bad == ["Interest (USD)"]


def test_warnings(loaded):
    b, _ = loaded
    keys = {r.warn_key for r in b.warnings.collect()}
    assert {"unknown_section|Crypto Lending", "not_derived|Corporate Actions", "closed_lots", "short|Odd"} <= keys


def test_stub_without_reference_rows(spark):
    text = "\n".join(
        [
            "Trades,Header,DataDiscriminator,Asset Category,Currency,Symbol,Date/Time,Quantity,T. Price,Proceeds,Comm/Fee,Code",
            'Trades,Data,Order,Stocks,USD,ZED,"2025-01-01, 10:00:00",5,1,-5,0,', 'Trades,Data,Order,Stocks,USD,SOLO,"2025-01-01, 10:00:00",5,1,-5,0,',
            "Dividends,Header,Currency,Date,Description,Amount", "Dividends,Data,USD,2025-01-05,ZED(US0000000099) Cash Dividend USD 0.1 per Share,0.5",
        ]
    )
    files = spark.createDataFrame([("p", "x.csv", text)], "portfolio_id string, path string, text string")
    b = ingest.derive_files(files)
    assert sorted(rows(b.instruments, "instrument_key", "identity_source", "symbol")) == [("SOLO", "symbol", "SOLO"), ("US0000000099", "isin", "ZED")]
    assert {r[0] for r in rows(b.distributions, "instrument_key")} == {"US0000000099"}


def test_pairing_by_rate_before_order(spark):
    d = spark.createDataFrame([("f", "K", 1, 0.5), ("f", "K", 2, 0.7), ("f", "K", 3, None)], "file_id string, who string, line_no int, per_share double")
    t = spark.createDataFrame([("f", "K", 11, 0.7), ("f", "K", 12, None), ("f", "K", 13, 0.1)], "file_id string, who string, line_no int, per_share double")
    fix = lambda x: x.withColumns({"date": F.lit("2025-01-01").cast("date"), "currency": F.lit("USD"), "order": F.struct(F.lit("Dividends"), "line_no")})
    got = sorted(rows(derive.pair_withholding(fix(d), fix(t)), "tax_line", "line_no"))
    assert got == [(11, 2), (12, 1), (13, 3)]


def test_a_table_is_derived_only_when_asked_for(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("derived without need")

    for name in ("context", "transactions", "distributions", "cash_events"):
        monkeypatch.setattr(derive, name, refused)
    files = spark.createDataFrame([("p", "x.csv", quarter())], "portfolio_id string, path string, text string")
    b = ingest.derive_files(files)
    assert b.raw_files.count() == 1 and b.raw_rows.count() > 0
    with pytest.raises(AssertionError):
        _ = b.transactions


def test_comparable_cells(spark):
    cells = ["", "--", " - ", "1,234.50", "-0", "-0.000", "100", "0.5", "007", "1,23", "2001-02-03", "2001-02-03, 10:11:12", "2001-02-03  10:11:12", "2001-02-03x", "a  b\tc ", "1e5", "9" * 400, None]
    want = ["", "", "", "1234.5", "0", "0", "100", "0.5", "7", "1,23", "2001-02-03", "2001-02-03T10:11:12", "2001-02-03T10:11:12", "2001-02-03x", "a b c", "1e5", "Infinity", ""]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(T.canon("c")).collect()] == want
    cell = F.when(F.col("c") == "", "").otherwise(T.plain_cell("c"))
    assert [r[0][0] for r in df.select(F.transform(F.transform(F.array(cell), lambda x: x), lambda t: T.canon_plain(t))).collect()] == want
