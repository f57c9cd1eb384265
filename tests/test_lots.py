import random
from collections import deque

import pytest
from helpers import one, tx
from pyspark.sql import functions as F

from ledgerspark.operators import lots


def summary(spark, fills):
    return lots.replay(tx(spark, fills)).summary().first()


def test_fifo(spark):
    led = lots.replay(tx(spark, [("2024-01-01", 100, 10), ("2024-02-01", 100, 20), ("2024-03-01", -100, 30)]))
    s = led.summary().first()
    assert (s.quantity, s.cost_fifo, s.realized_fifo) == (100, 2000, 2000)
    assert one(led.open_lots(), "lot_id", "quantity") == ("001", 100)


def test_fifo_splits_a_lot(spark):
    led = lots.replay(tx(spark, [("2024-01-01", 60, 10), ("2024-02-01", 60, 20), ("2024-03-01", -90, 25)]))
    assert led.lot_consumption().agg(F.count(F.lit(1)), F.sum("cost")).first()[0:2] == (2, 1200)
    assert led.summary().first().quantity == 30


def test_average_is_fixed_at_the_sale(spark):
    s = summary(spark, [("2024-01-01", 100, 10), ("2024-02-01", 100, 20), ("2024-03-01", -150, 30)])
    assert s.cost_average == pytest.approx(750) and s.cost_average / s.quantity == pytest.approx(15)


def test_fees(spark):
    s = summary(spark, [("2024-01-01", 100, 10, 5), ("2024-02-01", -100, 12, 4)])
    assert (s.total_cost, s.total_proceeds, s.realized_fifo) == (1005, 1196, 191) and s.realized_average == pytest.approx(191)


def test_methods_agree_on_total_gain(spark):
    s = lots.total_gain(lots.replay(tx(spark, [("2024-01-01", 100, 10, 5), ("2024-02-01", 100, 20, 5), ("2024-03-01", -100, 30, 5)])).summary(), F.lit(25.0)).first()
    assert s.total_gain == pytest.approx(2485) and s.realized_fifo == pytest.approx(1990) and s.realized_average == pytest.approx(1490)
    assert s.realized_fifo + 25 * s.quantity - s.cost_fifo == pytest.approx(s.realized_average + 25 * s.quantity - s.cost_average)


def test_reopen(spark):
    s = summary(spark, [("2024-01-01", 100, 10), ("2024-02-01", -100, 12), ("2024-03-01", 50, 20)])
    assert (s.reopens, s.realized_fifo, s.cost_fifo / s.quantity) == (1, 200, 20)


def test_uncovered(spark):
    s = summary(spark, [("2024-01-01", 40, 10), ("2024-02-01", -100, 12)])
    assert (s.quantity, s.uncovered) == (0, 60)


def test_buys_before_sells_in_the_same_second(spark):
    s = summary(spark, [("2024-01-01T10:00:00", -100, 11), ("2024-01-01T10:00:00", 100, 10)])
    assert (s.uncovered, s.realized_fifo) == (0, 100)


def test_price_recovered_and_rows_ignored(spark):
    s = summary(spark, [("2024-01-01", 100, 0, 0, -1500), ("2024-01-02", 100, 9, 0, None, ["Closed-Lot"]), ("2024-01-03", float("nan"), 9)])
    assert (s.quantity, s.cost_fifo) == (100, 1500)


def test_method_projection(spark):
    s = lots.cost_basis(lots.replay(tx(spark, [("2024-01-01", 10, 1), ("2024-01-02", -10, 2)])).summary(), "AVERAGE").first()
    assert s.avg_unit_cost is None and s.realized == pytest.approx(10)


def queue_replay(fills):
    """Sequential second opinion for one ledger."""
    book, held, avg, unc, used = deque(), 0.0, 0.0, 0.0, 0.0
    for f in sorted(fills, key=lambda f: (f[0], f[1] <= 0)):
        q, price = round(f[1], 9), f[2]
        if q > 0:
            book.append([q, price])
            held, avg = round(held + q, 9), avg + q * price
            continue
        need = -q
        avg -= avg * min(need, held) / held if held > 0 else 0
        while need > 1e-9 and book:
            take = min(book[0][0], need)
            used += take * book[0][1]
            book[0][0], need = round(book[0][0] - take, 9), round(need - take, 9)
            if book[0][0] <= 1e-9:
                book.popleft()
        unc, held = unc + need, round(max(0.0, held + q), 9)
    return held, sum(a * b for a, b in book), avg if held else 0.0, unc, used


@pytest.mark.parametrize("hot", [{}, {"hot_rows": 20, "chunk_rows": 9}])
def test_random_ledgers(spark, hot):
    rnd = random.Random(7)
    want, df = {}, None
    for k in range(8):
        fills = []
        for i in range(10 if k == 0 else 60):
            day = f"2024-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}T{i % 24:02d}:{i // 24:02d}:00"
            fills.append((day, rnd.choice([1, 1, -1, -1.3]) * rnd.randint(1, 500) / rnd.choice([1, 4]), rnd.randint(100, 900) / 10))
        want[f"K{k}"] = queue_replay(fills)
        part = tx(spark, fills, key=f"K{k}")
        df = part if df is None else df.unionByName(part)
    for r in lots.replay(df, **hot).summary().collect():
        held, fifo, avg, unc, used = want[r.instrument_key]
        assert r.quantity == pytest.approx(held, abs=1e-6) and r.uncovered == pytest.approx(unc, abs=1e-6)
        assert r.cost_fifo == pytest.approx(fifo, abs=1e-4) and r.cost_average == pytest.approx(avg, abs=1e-4)
        assert r.total_proceeds - r.realized_fifo == pytest.approx(used, abs=1e-4)


def test_average_survives_a_vanishing_product(spark):
    fills = [("2024-01-01", 1000, 10)]
    for i in range(400):
        day = f"2024-02-01T{i // 60:02d}:{i % 60:02d}:"
        fills += [(day + "01", -900, 10), (day + "02", 900, 10 + i % 3)]
    s = summary(spark, fills)
    assert s.quantity == 1000 and s.cost_average == pytest.approx(queue_replay(fills)[2])
