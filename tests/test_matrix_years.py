"""The wide matrix over every year of the data."""

from ledgerspark.operators import income


def test_every_year_reaches_a_cell(spark):
    rows = [("p", "K", "1995-01", 1.0, "cell"), ("p", "K", "1999-12", 2.0, "cell"), ("p", "L", "2001-07", 4.0, "cell"), ("p", "K", None, 3.0, "row"), ("p", None, None, 7.0, "grand")]
    m = spark.createDataFrame(rows, "portfolio_id string, group_key string, month string, amount double, level string")
    got = {(r.group_key, r.year): [r[f"m{i:02d}"] for i in range(1, 13)] for r in income.matrix_by_year(m).collect()}
    assert got == {("K", "1995"): [1.0] + [0.0] * 11, ("K", "1999"): [0.0] * 11 + [2.0], ("L", "2001"): [0.0] * 6 + [4.0] + [0.0] * 5}
