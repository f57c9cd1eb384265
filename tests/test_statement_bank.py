"""The statement queries against their SQL, and the traps that the rendered statements hold."""

import duckdb
import pytest

from ledgerspark.plans import books, statement_queries  # noqa: F401
from ledgerspark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [n for n in QUERIES if QUERIES[n].__module__ == statement_queries.__name__]


def plain(v):
    return round(v, 4) if isinstance(v, float) else v


def same(rows, cols):
    return sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert same([r.asDict() for r in got.collect()], cols) == same([dict(zip(want.columns, r)) for r in want.fetchall()], cols)


def test_traps_are_there(spark, tables):
    checks = [r.ok for r in QUERIES["statement_checks"](spark, SF).collect()]
    assert True in checks and False in checks
    paid = QUERIES["statement_distributions"](spark, SF)
    assert paid.where("ex_date IS NULL").count() and paid.where("tax = 0").count() and paid.where("tax > 0").count()
    kinds = {r.kind for r in QUERIES["statement_cash"](spark, SF).select("kind").distinct().collect()}
    assert kinds == {"FX", "FEE", "TAX", "DEPOSIT", "WITHDRAWAL", "INTEREST"}
    assert QUERIES["statement_merge"](spark, SF).where("reports > events").count()


def test_empty_tables(spark):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet").where("false") for t in ("orders", "lineitem"))
    assert books.files(spark, orders, lines).columns == ["portfolio_id", "path", "text"]
    assert books.files(spark, orders, lines).count() == 0

