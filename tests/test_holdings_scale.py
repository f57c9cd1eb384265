import pytest
from helpers import rates, settings, tx
from test_metrics import build

from ledgerspark.operators import fx, holdings, lots, scan

FILLS = [("2025-01-01", 10, 5, 1), ("2025-02-01", 4, 6), ("2025-03-01", -12, 7, 2), ("2025-04-01", 5, 8), ("2025-05-01", -20, 9)]


def cases(spark):
    t = tx(spark, FILLS, key="a", currency="EUR").unionByName(tx(spark, FILLS[:3], key="b")).unionByName(tx(spark, FILLS[2:], key="c", currency="GBP"))
    return t, fx.resolve_rates(rates(spark, [("EUR", "USD", f"2025-0{m}-01", 1 + m / 10) for m in range(1, 6)] + [("EUR", "USD", "2025-06-20", 1.085)]), ["USD"])


def test_holdings_store_no_replayed_rows(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(holdings, "cut_lineage", lambda df: stored.append(df.columns) or df)
    build(spark, cases(spark)[0])
    assert stored and not any("seg" in columns for columns in stored)


@pytest.mark.parametrize("method", ["FIFO", "AVERAGE"])
def test_legs_added_up_while_replaying_equal_those_of_stored_rows(spark, method):
    t, book = cases(spark)
    whole = lots.replay(t).for_holdings()
    bases = settings(spark, "USD", method).withColumnRenamed("cost_basis_method", "method")
    stored = whole.summary().join(holdings._cost_legs(whole, bases, book), lots.LEDGER, "left").join(holdings._realized_legs(whole, bases, book), lots.LEDGER, "left")
    got = {r.instrument_key: r for r in holdings._summary_and_legs(lots.replay(t), bases, book).collect()}
    want = {r.instrument_key: r for r in stored.collect()}
    assert got.keys() == want.keys() and all(got[k].asDict() == want[k].asDict() for k in want)
    assert {k: r.lots_gap for k, r in got.items()} == {"a": None, "b": False, "c": None} and got["a"].sales_base is not None


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", 2)
    t = tx(spark, FILLS * 8)
    assert lots.replay(t).rows.rdd.getNumPartitions() == 20
    few, none = scan.split_hot(t, lots.LEDGER, 100)
    assert none is None and few.count() == 40
    few, hot = scan.split_hot(t.unionByName(tx(spark, FILLS, key="k")), lots.LEDGER, 10)
    assert (few.count(), hot.count()) == (5, 40)
