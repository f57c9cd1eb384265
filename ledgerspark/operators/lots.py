"""Cost basis: FIFO lots and moving average from one pass over the fills.

FIFO needs no queue.  On the axis of cumulative shares every buy ends at the
running total of buys and every covered sale at the running total of covered
sales, so sorting both end points on that axis cuts it into segments that each
belong to exactly one lot and at most one sale.  Every fill owns one end point,
hence one output row per fill and a single shuffle by ledger.

The moving average is a linear recurrence: a sale scales the held cost, a buy
adds to it.  It is solved with running sums in log space, in blocks narrow
enough for doubles; contributions two blocks back are below 1e-43 of a cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.numeric import EPS_QTY, QTY_TYPE, exact_sum, finite
from ledgerspark.operators.scan import HOT_ROWS, Ordered, split_hot

LEDGER = ["portfolio_id", "instrument_key"]
ORDER = ["ts", "side", "id"]
_BLOCK = 100.0


def replayable(df: DataFrame) -> DataFrame:
    """Live rows with a finite quantity that are not closed-lot restatements."""
    closed = F.exists("codes", lambda c: F.lower(F.regexp_replace(c, r"[\s_-]", "")) == "closedlot")
    keep = finite("quantity").isNotNull()
    if "superseded_at" in df.columns:
        keep = keep & F.col("superseded_at").isNull()
    if "codes" in df.columns:
        keep = keep & ~F.coalesce(closed, F.lit(False))
    return df.where(keep)


def unit_price(price: Column, quantity: Column, proceeds: Column) -> Column:
    """Absolute price; a missing or zero price is recovered from the proceeds."""
    p, v = finite(price), finite(proceeds)
    recovered = F.try_divide(F.abs(v), F.abs(quantity))
    return F.when(p != 0, F.abs(p)).when(v != 0, recovered).otherwise(F.lit(0.0))


def _prepare(df: DataFrame) -> DataFrame:
    rows = replayable(df)
    q = F.col("quantity").cast("double")
    proceeds = F.col("proceeds") if "proceeds" in df.columns else F.lit(None).cast("double")
    rows = rows.select(
        *LEDGER, "id", "ts", F.col("date"), F.col("currency"),
        F.round(q, 9).cast(QTY_TYPE).alias("q"),
        unit_price(F.col("price"), q, proceeds).alias("unit"),
        F.abs(F.coalesce(finite("fees"), F.lit(0.0))).alias("fee"),
    )
    kind = F.when(F.col("q") > F.lit(EPS_QTY).cast(QTY_TYPE), 1).when(F.col("q") < F.lit(-EPS_QTY).cast(QTY_TYPE), -1).otherwise(0)
    return rows.withColumn("kind", kind).withColumn("side", F.when(F.col("kind") == 1, 0).otherwise(1))


def _positions(scan: Ordered) -> Ordered:
    """Clamped position and uncovered shares as a reflected running sum."""
    zero = F.lit(0).cast("decimal(38,9)")
    scan.running(net=("sum", F.col("q")), ledger_currency=("first", F.col("currency")))
    scan.df = scan.df.drop("currency").withColumnRenamed("ledger_currency", "currency")
    scan.running(low=("min_before", F.col("net")))
    was_short = F.greatest(zero, -F.coalesce(F.col("low"), zero))
    is_short = F.greatest(zero, -F.least(F.coalesce(F.col("low"), zero), F.col("net")))
    scan.df = scan.df.withColumns(
        {
            "held_before": (F.col("net") - F.col("q") + was_short).cast("decimal(38,9)"),
            "held": (F.col("net") + is_short).cast("decimal(38,9)"),
            "uncovered": (is_short - was_short).cast("decimal(38,9)"),
        }
    )
    buy, sell = F.col("kind") == 1, F.col("kind") == -1
    none = F.lit(0).cast("decimal(38,9)")
    scan.df = scan.df.withColumn(
        "opens", F.when(buy & (F.col("held_before") <= F.lit(0)), 1).otherwise(0)
    ).withColumn("covered", F.when(sell, (-F.col("q") - F.col("uncovered")).cast("decimal(38,9)")).otherwise(none))
    return scan.running(
        epoch=("sum", F.col("opens")),
        bought=("sum", F.when(buy, F.col("q")).otherwise(F.lit(0).cast(QTY_TYPE))),
        sold=("sum", F.col("covered")),
    )


def _average(scan: Ordered) -> Ordered:
    """Held cost after every row under the moving average."""
    buy, sell = F.col("kind") == 1, F.col("kind") == -1
    left = F.col("held").cast("double") / F.col("held_before").cast("double")
    flat = F.col("held") <= F.lit(0)
    add = F.when(buy, F.col("q").cast("double") * F.col("unit") + F.col("fee")).otherwise(F.lit(0.0))
    shrink = F.when(sell & ~flat & (F.col("held_before") > 0), F.log(left)).otherwise(F.lit(0.0))
    scan.df = scan.df.withColumns({"add": add, "shrink": shrink})
    # not reset per epoch: only differences inside an epoch are ever used
    scan.running(depth=("sum", F.col("shrink")))
    df = scan.frame().withColumn("block", F.floor(-F.col("depth") / _BLOCK).cast("long"))
    df = df.withColumn("scaled", F.col("add") * F.exp(-(F.col("depth") + F.col("block") * _BLOCK)))

    # running total inside the block, and the total of the block just before in its own scale
    group = scan.keys + ["epoch"]
    blocks = scan.refine(df, ["epoch", "block"])
    blocks.running(inside=("sum", F.col("scaled")))
    out = blocks.frame()
    if scan.chunked:
        totals = df.groupBy(*group, "block").agg(F.sum("scaled").alias("carried"))
        totals = totals.withColumn("block", F.col("block") + 1)
        out = out.join(totals, [*group, "block"], "left")
    else:
        # both windows need the row order `inside` already has, so nothing is sorted again
        along = W.partitionBy(*group).orderBy("block", *scan.order)
        at_start = F.when(F.lag("block").over(along) == F.col("block") - 1, F.lag("inside").over(along))
        out = out.withColumn("before_block", at_start)
        within = W.partitionBy(*group, "block").orderBy(*scan.order).rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn("carried", F.first("before_block").over(within)).drop("before_block")
    grow = F.exp(F.col("depth") + F.col("block") * _BLOCK)
    carried = F.coalesce(F.col("carried"), F.lit(0.0)) * F.exp(F.lit(-_BLOCK))
    cost_held = F.when(flat, F.lit(0.0)).otherwise(grow * (F.col("inside") + carried))
    out = out.withColumn("cost_held", cost_held)
    # before a sale: undo its own factor; a full exit takes everything that was held
    before = F.when(flat, grow * (F.col("inside") + carried)).otherwise(F.col("cost_held") / F.exp(F.col("shrink")))
    had = F.col("held_before") > 0
    out = out.withColumn("avg_taken", F.when(sell & had, before - F.col("cost_held")).otherwise(F.lit(0.0)))
    drop = ["add", "shrink", "depth", "block", "scaled", "carried", "inside"]
    return scan.resort(out.drop(*drop), scan.order)


class Ledger:
    """Replayed fills; every view below is a projection or grouping of `rows`.

    `apart`: each ledger lies in one partition, none of them is hot.
    """

    def __init__(self, rows: DataFrame, apart: bool = False):
        self.rows, self.apart = rows, apart

    def lot_consumption(self) -> DataFrame:
        """Which lot funded which sale: one row per (sale, lot) pair."""
        return self.rows.where((F.col("seg") > 0) & F.col("sale").isNotNull()).select(
            *LEDGER, "currency",
            F.col("sale.id").alias("sale_id"), F.col("sale.date").alias("sale_date"),
            F.col("lot.id").alias("lot_id"), F.col("lot.date").alias("lot_date"),
            F.col("seg").cast("double").alias("quantity"), F.col("seg_cost").alias("cost"),
        )

    def open_lots(self) -> DataFrame:
        """Remaining lots with quantity, unit cost and fee per share."""
        return self.rows.where((F.col("seg") > 0) & F.col("sale").isNull()).select(
            *LEDGER, "currency",
            F.col("lot.id").alias("lot_id"), F.col("lot.date").alias("lot_date"), F.col("lot.ts").alias("lot_ts"),
            F.col("seg").cast("double").alias("quantity"), F.col("lot.unit").alias("unit_cost"),
            F.col("lot.fee_per_share").alias("fee_per_share"), F.col("seg_cost").alias("cost"),
        )

    def sales(self) -> DataFrame:
        """One row per sale with the cost consumed and gain under both methods."""
        by_sale = (
            self.rows.where(F.col("sale").isNotNull())
            .groupBy(*LEDGER, F.col("sale.id").alias("sale_id"))
            .agg(
                F.first("sale").alias("s"), F.first("currency").alias("currency"),
                exact_sum(F.when(F.col("seg") > 0, F.col("seg_cost"))).alias("fifo"),
            )
        )
        proceeds = F.col("s.qty") * F.col("s.unit") - F.col("s.fee")
        fifo = F.coalesce(F.col("fifo"), F.lit(0.0))
        return by_sale.select(
            *LEDGER, "sale_id", "currency", F.col("s.date").alias("sale_date"), F.col("s.ts").alias("sale_ts"),
            F.col("s.qty").alias("quantity"), F.col("s.unit").alias("price"), F.col("s.fee").alias("fees"),
            proceeds.alias("proceeds_net"), fifo.alias("cost_fifo"), (proceeds - fifo).alias("realized_fifo"),
            F.col("s.avg_taken").alias("cost_average"), (proceeds - F.col("s.avg_taken")).alias("realized_average"),
            F.col("s.uncovered").alias("uncovered"),
        )

    def for_holdings(self) -> "Ledger":
        """Only the columns that the summary and the legs in base currency read, to be written and read several times."""
        return Ledger(
            self.rows.select(
                *LEDGER, *ORDER, "date", "currency", "q", "unit", "fee", "kind", "held", "uncovered", "opens", "cost_held", "avg_taken", "seg", "seg_cost",
                F.when(F.col("lot").isNotNull(), F.struct("lot.date")).alias("lot"),
                F.when(F.col("sale").isNotNull(), F.struct(*[f"sale.{c}" for c in ("id", "date", "qty", "unit", "fee", "avg_taken")])).alias("sale"),
            )
        )

    def summary(self, **more: Column) -> DataFrame:
        """One row per ledger: quantity, cost and gain totals, counts, dates, and `more` aggregates."""
        buy, sell = F.col("kind") == 1, F.col("kind") == -1
        q = F.abs(F.col("q")).cast("double")
        gross = q * F.col("unit")
        last = F.struct(*ORDER)
        moved = F.when(F.col("kind") != 0, last)
        agg = self.rows.groupBy(*LEDGER).agg(
            F.min_by("currency", last).alias("currency"),
            F.max_by(F.col("held").cast("double"), last).alias("quantity"),
            F.sum(F.when(buy, gross + F.col("fee")).try_cast("decimal(38,12)")).alias("b"),
            F.sum(F.when(sell, gross - F.col("fee")).try_cast("decimal(38,12)")).alias("p"),
            exact_sum(F.when(F.col("kind") != 0, F.col("fee"))).alias("f"),
            exact_sum(F.when((F.col("seg") > 0) & F.col("sale").isNull(), F.col("seg_cost"))).alias("open_cost"),
            exact_sum(F.when((F.col("seg") > 0) & F.col("sale").isNotNull(), F.col("seg_cost"))).alias("used_cost"),
            F.max_by("cost_held", moved).alias("avg_cost_held"),
            exact_sum("avg_taken").alias("avg_used"),
            F.sum("uncovered").cast("double").alias("uncovered"),
            F.sum("opens").alias("opened"),
            F.min_by("side", moved).alias("first_side"),
            F.min("date").alias("first_activity"), F.max("date").alias("last_activity"),
            F.min(F.when(buy, F.col("date"))).alias("first_purchase"),
            F.count_if(buy).alias("buy_count"), F.count_if(sell).alias("sell_count"), *[x.alias(n) for n, x in more.items()],
        )
        z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        # the first buy opens a trade without re-opening one, unless a sale came before it
        again = F.col("opened") - F.when((F.col("first_side") == 0) & (F.col("opened") > 0), 1).otherwise(0)
        return agg.select(
            *LEDGER, "currency", "quantity", z("b").alias("total_cost"), z("p").alias("total_proceeds"),
            z("f").alias("total_fees"), z("open_cost").alias("cost_fifo"), z("avg_cost_held").alias("cost_average"),
            (z("p") - z("used_cost")).alias("realized_fifo"), (z("p") - z("avg_used")).alias("realized_average"),
            "uncovered", again.alias("reopens"), "first_activity", "last_activity", "first_purchase",
            "buy_count", "sell_count", *more,
        )


def replay(transactions: DataFrame, *, hot_rows: int | None = None, chunk_rows: int | None = None) -> Ledger:
    """Replay all ledgers: order by time, buys before sells, then id."""
    rows = _prepare(transactions)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    moderate, hot = split_hot(rows, LEDGER, limit)
    done = _replay(Ordered(moderate, LEDGER, ORDER, chunked=False))
    if hot is not None:
        done = done.unionByName(
            _replay(Ordered(hot, LEDGER, ORDER, hot_rows=limit, chunk_rows=chunk_rows, chunked=True))
        )
    return Ledger(done, apart=hot is None)


def _replay(scan: Ordered) -> DataFrame:
    scan = _average(_positions(scan))

    buy, sell = F.col("kind") == 1, F.col("kind") == -1
    q = F.abs(F.col("q")).cast("double")
    lot = F.struct("id", "date", "ts", "unit", (F.col("fee") / q).alias("fee_per_share"))
    sale = F.struct(
        "id", "date", "ts", q.alias("qty"), "unit", "fee", "avg_taken",
        F.col("uncovered").cast("double").alias("uncovered"),
    )
    # a dust row sits at the current buy end, where its segment is empty
    ends = scan.frame().withColumns(
        {
            "spot": F.when(sell, F.col("sold")).otherwise(F.col("bought")).cast("decimal(38,9)"),
            "lot0": F.when(buy, lot), "sale0": F.when(sell, sale),
        }
    )
    axis = scan.resort(ends, ["spot", "ts", "side", "id"])
    axis.running(lot=("next", F.col("lot0")), sale=("next", F.col("sale0")), start=("lag", F.col("spot")))
    seg = (F.col("spot") - F.coalesce(F.col("start"), F.lit(0).cast("decimal(38,9)"))).cast("decimal(38,9)")
    out = axis.frame().withColumn("seg", seg)
    cost = F.col("seg").cast("double") * (F.col("lot.unit") + F.col("lot.fee_per_share"))
    return out.withColumn("seg_cost", cost).drop("lot0", "sale0", "start", "bought", "sold", "net", "low")


def cost_basis(summary: DataFrame, method: str | Column) -> DataFrame:
    """Project the summary on FIFO or AVERAGE (a literal or a per-row column)."""
    m = F.lit(method) if isinstance(method, str) else method
    fifo = m == "FIFO"
    basis = F.when(fifo, F.col("cost_fifo")).otherwise(F.col("cost_average"))
    return summary.withColumns(
        {
            "method": m, "cost_basis": basis,
            "avg_unit_cost": F.when(F.col("quantity") > 0, basis / F.col("quantity")),
            "realized": F.when(fifo, F.col("realized_fifo")).otherwise(F.col("realized_average")),
        }
    )


def total_gain(summary: DataFrame, price: Column) -> DataFrame:
    """Realized plus unrealized gain; the same under either method."""
    gain = F.col("total_proceeds") + F.col("quantity") * price - F.col("total_cost")
    return summary.withColumn("total_gain", gain)


def quantity_as_of(transactions: DataFrame, dates: DataFrame) -> DataFrame:
    """Signed ledger quantity up to each (ledger, as_of) in `dates`."""
    # one row per day first: the join then carries days, not fills
    rows = replayable(transactions).groupBy(*LEDGER, "date").agg(exact_sum("quantity").alias("quantity"))
    return (
        dates.join(rows, LEDGER, "left")
        .groupBy(*LEDGER, "as_of")
        .agg(F.coalesce(exact_sum(F.when(F.col("date") <= F.col("as_of"), F.col("quantity"))), F.lit(0.0)).alias("ledger_quantity"))
    )
