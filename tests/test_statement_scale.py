"""Statements are printed and read in small steps: facts from stored facts, columns looked up once per header, shared steps stored."""

from pyspark.sql import functions as F

from ledgerspark.functions.text import canon
from ledgerspark.operators import sections
from ledgerspark.plans import books, ingest
from ledgerspark.sources import statements

SCHEMA = "portfolio_id string, path string, text string"
TEXT = """Statement,Header,Field Name,Field Value
Statement,Data,Period,2001
Trades,Header,DataDiscriminator,Asset Category,Currency,Symbol,Date/Time,Quantity,T. Price,Proceeds,Comm in EUR,Code
Trades,Data,Order,Stocks,USD,AAA,"2001-02-03, 09:30:00",5,"1,010.50",-50,-2,O
Dividends,Header,Currency,Date,Description,Date,Amount
Dividends,Data,USD,2001-03-04,AAA(US0000000001) Cash Dividend USD 0.50 per Share (Ordinary Dividend),x
Dividends,Header,Value Date,Amount,Settle Date,Currency
Dividends,Data,2001-05-06,"1,7",2001-05-07,EUR
Orphan,Data,1,2"""


def plans_of(monkeypatch, module):
    """Plans of the steps that a module stores from now on."""
    seen, stored = [], module.keep

    def keep(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(module, "keep", keep)
    return seen


def tables(spark):
    orders = spark.range(0, 1200).selectExpr(
        "id AS o_orderkey", "id * 7 AS o_custkey", "CAST(1000.25 + id AS DOUBLE) AS o_totalprice", "timestamp_seconds(946684800 + id * 86400) AS o_orderdate")
    lines = spark.range(0, 2400).selectExpr(
        "id div 2 AS l_orderkey", "CAST(id % 2 + 1 AS INT) AS l_linenumber", "id * 3 AS l_partkey", "CASE WHEN id % 5 = 0 THEN 'R' ELSE 'N' END AS l_returnflag",
        "CAST(id % 40 + 1 AS DOUBLE) AS l_quantity", "CAST(10.5 + id AS DOUBLE) AS l_extendedprice", "timestamp_seconds(946684800 + id * 43200) AS l_shipdate")
    return orders, lines


def test_orders_are_read_for_two_facts_only(spark, monkeypatch):
    plans = plans_of(monkeypatch, books)
    files = books.files(spark, *tables(spark))
    assert len([p for p in plans if "orderdate" in p or "custkey" in p]) == 1  # all others come from what is stored
    last = files._jdf.queryExecution().optimizedPlan().toString()
    assert last.count("Aggregate") < 10
    assert files.count() == 4


def test_totals_of_a_statement(spark):
    text = {r.path: r.text for r in books.files(spark, *tables(spark)).collect()}["whole-000000001"]
    rows = [r.split(",") for r in text.split("\n")]
    dividends = [round(float(r[-1]) * 100) for r in rows if r[:2] == ["Dividends", "Data"] and r[2] in ("USD", "EUR")]
    (total,) = [r for r in rows if r[:3] == ["Dividends", "Data", "Total Dividends in USD"]]
    assert dividends and sum(dividends) == round(float(total[-1]) * 100)
    fills = [r for r in rows if r[:2] == ["Trades", "Data"]]
    assert {r[2] for r in fills} >= {"Order", "Trade", "ClosedLot"}


def rows_of(spark):
    files = statements.identify(spark.createDataFrame([("p", "a", TEXT)], SCHEMA))
    return statements.bind_headers(statements.records(files), places=sections.places)


def test_columns_under_their_headers(spark):
    names = ["currency", "date", "date_time", "amount", "commission", "price", "symbol"]
    got = {r.line_no: tuple(r)[1:] for r in rows_of(spark).select("line_no", *[sections.cell(n).alias(n) for n in names]).collect()}
    assert got[4] == ("USD", "2001-02-03, 09:30:00", "2001-02-03, 09:30:00", "", "-2", "1,010.50", "AAA")
    assert got[6][:4] == ("USD", "2001-03-04", "2001-03-04", "")  # the first of two equal names; a row shorter than its header
    assert got[8][:4] == ("EUR", "2001-05-07", "2001-05-07", "1,7")  # bound anew; by preference, not by place
    assert got[9] == ("",) * 7


def test_rows_are_stored_without_cells(spark):
    bundle = ingest.derive_files(spark.createDataFrame([("p", "a", TEXT)], SCHEMA))
    assert not {"cells", "canonicals"} & set(bundle.raw_rows.columns)
    old = ingest.derive_rows(bundle.raw_files, bundle.raw_rows.drop("places"), None)
    assert [tuple(r) for r in old.transactions.collect()] == [tuple(r) for r in bundle.transactions.collect()]


def test_key_of_one_section_equals_the_key_of_all(spark):
    rows = rows_of(spark).where("row_type = 'Data'")
    for name in ("Trades", "Dividends", "Orphan"):
        mine = rows.where(F.col("section") == name)
        assert mine.select(sections.natural_key(F.lit("K"), name)).collect() == mine.select(sections.natural_key(F.lit("K"))).collect()
    key = rows.where("section = 'Trades'").select(sections.natural_key(F.lit("K"), "Trades").alias("k")).first()
    assert key.k.split("\x1f") == ["trade", "ORDER", "Stocks", "USD", "K", "2001-02-03T09:30:00", "5", "1010.5"]
    short = rows.select(sections.natural_key(F.lit("K"), "Trades").alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "divaccr" not in short
    assert rows.where("line_no = 8").select(canon(sections.cell("amount"))).first()[0] == "1,7"


def test_dividends_are_paired_from_stored_steps(spark, monkeypatch):
    plans = plans_of(monkeypatch, ingest)
    bundle = ingest.derive_files(spark.createDataFrame([("p", "a", TEXT)], SCHEMA))
    assert sorted((r.gross, r.currency) for r in bundle.distributions.collect()) == [(0.0, "USD"), (17.0, "EUR")]
    assert "places" not in plans[-1]  # the raw rows were read by earlier, smaller steps
    assert bundle.accrual_rows is bundle._ctx.accruals
