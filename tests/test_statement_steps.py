"""Steps that many tables of a statement share are computed once."""

from ledgerspark.plans import ingest

TEXT = """Statement,Header,Field Name,Field Value
Statement,Data,Period,2001
Trades,Header,DataDiscriminator,Asset Category,Currency,Symbol,Date/Time,Quantity,T. Price,Proceeds,Comm/Fee,Code
Trades,Data,Order,Stocks,USD,AAA,"2001-02-03, 09:30:00",5,10,-50,0,O
Financial Instrument Information,Header,Asset Category,Symbol,Description,Conid,Security ID
Financial Instrument Information,Data,Stocks,AAA,Fund A,77,US0000000001"""


def test_securities_are_resolved_once(spark):
    files = spark.createDataFrame([("p", "a", TEXT)], "portfolio_id string, path string, text string")
    bundle = ingest.derive_files(files)
    plan = bundle.instruments._jdf.queryExecution().optimizedPlan().toString()
    assert "cells" not in plan  # neither mentions nor reference rows are read from the raw rows again
    (row,) = bundle.instruments.collect()
    assert (row.instrument_key, row.symbol, str(row.first_seen)) == ("77", "AAA", "2001-02-03")
    assert [r.instrument_key for r in bundle.transactions.collect()] == ["77"]
