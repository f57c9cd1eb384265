"""Derived rows against the totals a statement prints about itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.numeric import exact_sum, round_up6
from ledgerspark.functions.text import asset_bucket, num, num0
from ledgerspark.operators import derive
from ledgerspark.operators.sections import BALANCE_LABEL, CASH_KINDS, IN_CURRENCY, TOTAL_LABEL, cell, trimmed

# Absolute and relative tolerance of a check.
ABS_TOLERANCE, REL_TOLERANCE = 0.02, 0.001


def agrees(ours: Column, theirs: Column) -> Column:
    diff = F.abs(ours - theirs)
    return (diff <= ABS_TOLERANCE) | ((theirs != 0) & (F.try_divide(diff, F.abs(theirs)) <= REL_TOLERANCE))


def _checks(df: DataFrame, label: Column, ours: Column, theirs: Column, currency: Column) -> DataFrame:
    return df.select(
        "file_id", label.alias("label"), round_up6(ours).alias("ours"), round_up6(theirs).alias("theirs"), currency.alias("currency"), agrees(ours, theirs).alias("ok")
    )


def _classified(rows: DataFrame, amount: Column) -> DataFrame:
    """Rows of a section marked as total, translated total, balance label or fact."""
    src = rows.where(F.col("row_type") != "Header").withColumn("amount", amount)
    total = F.col("row_type").isin("Total", "SubTotal") | F.col("first").rlike(TOTAL_LABEL)
    stated = F.nullif(F.regexp_extract("first", IN_CURRENCY, 1), F.lit(""))
    src = src.withColumns({"is_total": total, "stated": F.when(total, stated), "is_label": ~total & F.col("first").rlike(BALANCE_LABEL)})
    src = src.withColumn("is_fact", ~F.col("is_total") & ~F.col("is_label") & (F.col("row_type") == "Data"))
    w = W.partitionBy("file_id", "section").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    ccy = trimmed("currency")
    src = src.withColumn("row_currency", ccy).select("file_id", "section", "line_no", "first", "amount", "is_total", "stated", "is_label", "is_fact", "row_currency")
    return src.withColumns(
        {"facts": F.count_if("is_fact").over(w), "block_currency": F.last(F.when(F.col("is_fact"), F.col("row_currency")), ignorenulls=True).over(w)}
    )


def block_totals(marked: DataFrame) -> DataFrame:
    """Stated total per currency: the first bare total below each block of rows."""
    bare = marked.where(F.col("is_total") & F.col("stated").isNull() & F.col("amount").isNotNull() & (F.col("facts") > 0))
    first = bare.groupBy("file_id", "section", "facts").agg(F.min_by(F.struct("block_currency", "amount"), "line_no").alias("t"))
    return first.groupBy("file_id", "section", F.col("t.block_currency").alias("currency")).agg(exact_sum("t.amount").alias("theirs"))


def grand_totals(marked: DataFrame, files: DataFrame) -> DataFrame:
    """Last total stated in base, for sections that hold base currency only."""
    rows = marked.join(files.select("file_id", "base_currency"), "file_id")
    foreign = F.col("is_fact") & (F.col("row_currency") != "") & (F.col("row_currency") != F.col("base_currency"))
    own = (F.col("stated") == F.col("base_currency")) & F.col("amount").isNotNull()
    agg = rows.groupBy("file_id", "section", "base_currency").agg(
        F.bool_or(F.coalesce(foreign, F.lit(False))).alias("foreign"), F.max_by("amount", F.when(own, F.col("line_no"))).alias("theirs")
    )
    return agg.where(~F.col("foreign") & F.col("theirs").isNotNull() & F.col("base_currency").isNotNull())


def _section_checks(marked: DataFrame, files: DataFrame, ours: DataFrame, label: Column) -> list[DataFrame]:
    """Per-currency and grand-total checks; `ours`: file_id, section, currency, amount."""
    per = block_totals(marked).join(ours, ["file_id", "section", "currency"], "left")
    mine = F.coalesce("amount", F.lit(0.0))
    whole = ours.groupBy("file_id", "section").agg(exact_sum("amount").alias("amount"))
    grand = grand_totals(marked, files).join(whole, ["file_id", "section"], "left")
    return [
        _checks(per, F.concat(label, F.lit(" ("), "currency", F.lit(")")), mine, F.col("theirs"), F.col("currency")),
        _checks(grand, F.concat(label, F.lit(" — statement total")), mine, F.col("theirs"), F.col("base_currency")),
    ]


def positions(ctx: derive.Context) -> DataFrame:
    """Value and cost per currency block, and the stock line of the net asset value."""
    rows = ctx.positions
    ours = rows.where("is_fact").groupBy("file_id", "block").agg(exact_sum(F.coalesce("value", F.lit(0.0))).alias("v"), exact_sum(F.coalesce("cost", F.lit(0.0))).alias("c"))
    closed = rows.where("closes").select("file_id", "block", "block_currency", "value", "cost").join(ours, ["file_id", "block"])
    ccy = F.col("block_currency")
    value = _checks(closed.where(F.col("value").isNotNull()), F.concat(F.lit("Open Positions value ("), ccy, F.lit(")")), F.col("v"), F.col("value"), ccy)
    cost = _checks(closed.where(F.col("cost").isNotNull()), F.concat(F.lit("Open Positions cost basis ("), ccy, F.lit(")")), F.col("c"), F.col("cost"), ccy)

    stock = F.lower(asset_bucket(cell("asset_category"))).isin("stock", "stocks")
    book = rows.where("is_fact").join(ctx.files.select("file_id", "base_currency"), "file_id").groupBy("file_id", "base_currency").agg(
        exact_sum(F.when(stock, F.coalesce("value", F.lit(0.0)))).alias("ours"), F.count_if(stock).alias("stocks"),
        F.bool_or((F.col("currency") != "") & (F.col("currency") != F.col("base_currency"))).alias("foreign"),
    )
    nav = ctx.rows.where((F.col("section") == "Net Asset Value") & (F.col("row_type") == "Data") & F.lower("first").isin("stock", "stocks"))
    nav = nav.groupBy("file_id").agg(F.min_by(num(cell("nav_total")), "line_no").alias("theirs"))
    line = book.join(nav, "file_id").where((F.col("stocks") > 0) & ~F.col("foreign") & F.col("theirs").isNotNull())
    return value.unionByName(cost).unionByName(_checks(line, F.lit("Net Asset Value — Stock"), F.col("ours"), F.col("theirs"), F.col("base_currency")))


def cash(ctx: derive.Context, distributions: DataFrame, cash_events: DataFrame) -> DataFrame:
    """Dividends, withholding and every plain cash section."""
    names = ["Dividends", "Withholding Tax", *CASH_KINDS]
    marked = ctx.shared(_classified(ctx.rows.where(F.col("section").isin(*names)), num(cell("amount"))))
    paid = distributions.where(F.col("section") == "Dividends").select("file_id", "section", "currency", F.col("gross").alias("amount"))
    withheld = distributions.select("file_id", F.lit("Withholding Tax").alias("section"), "currency", (-F.col("tax")).alias("amount"))
    lines = cash_events.where(F.col("section") != "Trades").select("file_id", "section", "currency", "amount")
    ours = ctx.shared(paid.unionByName(withheld).unionByName(lines).groupBy("file_id", "section", "currency").agg(exact_sum("amount").alias("amount")))
    label = F.when(F.col("section") == "Withholding Tax", "Withholding tax").otherwise(F.col("section"))
    return reduce(DataFrame.unionByName, _section_checks(marked, ctx.files, ours, label))


def accruals(ctx: derive.Context) -> DataFrame:
    """Accrual change and open balance per currency, and the ending balance in base."""
    marked = ctx.shared(_classified(ctx.rows.where(F.col("section") == "Change in Dividend Accruals"), num(cell("net_amount"))))
    nets = derive.net_accruals(ctx.accruals, ["portfolio_id", "file_id"])
    ours = nets.groupBy("file_id", "currency").agg(exact_sum("net").alias("all"), exact_sum(F.when(F.col("open"), F.col("net"))).alias("open"))
    named = lambda p: F.min_by("amount", F.when(F.startswith("first", F.lit(p)), F.col("line_no")))
    labels = marked.where(F.col("is_label") & F.col("amount").isNotNull()).groupBy("file_id").agg(
        named("Starting Dividend Accruals").alias("starting"), named("Ending Dividend Accruals").alias("ending")
    )
    per = block_totals(marked).join(ours, ["file_id", "currency"], "left").join(labels, "file_id", "left")
    ccy = F.col("currency")
    flat = F.abs(F.coalesce("starting", F.lit(0.0))) <= ABS_TOLERANCE
    change = _checks(per, F.concat(F.lit("Dividend accrual change ("), ccy, F.lit(")")), F.coalesce("all", F.lit(0.0)), F.col("theirs"), ccy)
    still = _checks(per.where(flat), F.concat(F.lit("Open dividend accruals ("), ccy, F.lit(")")), F.coalesce("open", F.lit(0.0)), F.col("theirs"), ccy)
    whole = nets.join(ctx.files.select("file_id", "base_currency"), "file_id").where("open").groupBy("file_id").agg(
        exact_sum("net").alias("ours"), F.bool_and(F.col("currency") == F.col("base_currency")).alias("all_base")
    )
    end = labels.where(F.col("ending").isNotNull() & flat).join(whole, "file_id", "left").join(ctx.files.select("file_id", "base_currency"), "file_id")
    end = end.where(F.coalesce("all_base", F.lit(True)) & F.col("base_currency").isNotNull())
    return change.unionByName(still).unionByName(
        _checks(end, F.lit("Open dividend accruals"), F.coalesce("ours", F.lit(0.0)), F.col("ending"), F.col("base_currency"))
    )


def trades(ctx: derive.Context, transactions: DataFrame) -> DataFrame:
    """Quantity, proceeds, commission and realized gain against each printed subtotal."""
    by = ["file_id", "bucket", "currency", "who"]
    src = ctx.rows.where((F.col("section") == "Trades") & (F.col("row_type") == "SubTotal") & (trimmed("symbol") != ""))
    src = src.withColumns({"bucket": asset_bucket(cell("asset_category")), "currency": trimmed("currency"), "symbol": trimmed("symbol")})
    src = src.where(F.lower("bucket") != "forex")
    known = ctx.keyed.where(F.col("rank") <= 2).groupBy("file_id", "symbol").agg(F.min("instrument_key").alias("k"))
    theirs = src.join(known, ["file_id", "symbol"], "left").withColumn("who", F.coalesce("k", "symbol")).groupBy(*by).agg(
        exact_sum(num0(cell("quantity"))).alias("t_quantity"), exact_sum(num0(cell("proceeds"))).alias("t_proceeds"),
        exact_sum(F.abs(num0(cell("commission")))).alias("t_commission"), exact_sum(num0(cell("realized"))).alias("t_realized"),
    )
    ours = transactions.groupBy("file_id", "bucket", "currency", F.col("instrument_key").alias("who")).agg(
        exact_sum("quantity").alias("o_quantity"), exact_sum("proceeds").alias("o_proceeds"), exact_sum("fees").alias("o_commission"), exact_sum("realized_pnl").alias("o_realized")
    )
    parts = [(n, n.replace("realized", "realized P/L")) for n in ("quantity", "proceeds", "commission", "realized")]
    four = F.array(*[F.struct(F.lit(t).alias("what"), F.coalesce(f"o_{n}", F.lit(0.0)).alias("ours"), F.col(f"t_{n}").alias("theirs")) for n, t in parts])
    rows = theirs.join(ours, by, "left").withColumn("c", F.explode(four))
    label = F.concat(F.lit("Trades "), F.col("c.what"), F.lit(" "), "who", F.lit(" ("), "bucket", F.lit("/"), "currency", F.lit(")"))
    return _checks(rows, label, F.col("c.ours"), F.col("c.theirs"), F.col("currency"))
