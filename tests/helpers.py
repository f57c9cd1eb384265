import datetime as dt

from pyspark.sql import functions as F

TX = "portfolio_id string, instrument_key string, id string, ts timestamp, date date, currency string, quantity double, price double, fees double, proceeds double, codes array<string>, superseded_at timestamp"


def d(text):
    return dt.date.fromisoformat(text)


def tx(spark, fills, key="K", currency="USD"):
    """fills: (day or datetime text, quantity, price[, fee[, proceeds[, codes]]])."""
    rows = []
    for i, f in enumerate(fills):
        ts = dt.datetime.fromisoformat(f[0])
        fee = float(f[3]) if len(f) > 3 else 0.0
        proceeds = float(f[4]) if len(f) > 4 and f[4] is not None else None
        rows.append(("p", key, f"{i:03d}", ts, ts.date(), currency, float(f[1]), float(f[2]), fee, proceeds, list(f[5]) if len(f) > 5 else [], None))
    return spark.createDataFrame(rows, TX)


def rates(spark, rows):
    return spark.createDataFrame([(b, q, d(day), float(r)) for b, q, day, r in rows], "base string, quote string, date date, rate double")


def settings(spark, base="USD", method="FIFO"):
    return spark.createDataFrame([("p", base, method)], "portfolio_id string, base_currency string, cost_basis_method string")


def one(df, *cols):
    r = df.select(*cols).collect()
    assert len(r) == 1, r
    return tuple(r[0])


def lit_date(text):
    return F.lit(text).cast("date")
