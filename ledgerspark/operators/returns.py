"""Money- and time-weighted returns and drawdowns.

Cash-flow signs: XIRR counts money into the portfolio as negative; Dietz and TWR
count it as positive.  Returns are fractions.  Flows are first added up per
(portfolio, day), so per-portfolio arrays and windows hold at most one entry per
calendar day however many events there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.numeric import clamp, exact_sum, finite, is_zero
from ledgerspark.operators import fx

# Search bracket, stop widths and minimum span of the money-weighted return.
RATE_LOW, RATE_HIGH = -0.9999, 10.0
NPV_STOP, WIDTH_STOP = 1e-9, 1e-12
MIN_DAYS = 90
HALVINGS = 48


def external_flows(cash_events: DataFrame, settings: DataFrame, rates: fx.RateTable) -> DataFrame:
    """Deposits and withdrawals in base at their own dates (`amount_base` NULL without a rate)."""
    rows = cash_events.where(F.col("kind").isin("DEPOSIT", "WITHDRAWAL"))
    if "superseded_at" in rows.columns:
        rows = rows.where(F.col("superseded_at").isNull())
    rows = rows.join(settings.select("portfolio_id", "base_currency"), "portfolio_id")
    return fx.convert(rows, {"amount_base": "amount"}, "currency", "base_currency", "date", rates)


def invested(flows: DataFrame) -> DataFrame:
    """Net external contributions and how many flows could not be converted."""
    return flows.groupBy("portfolio_id").agg(
        F.coalesce(exact_sum("amount_base"), F.lit(0.0)).alias("invested_base"),
        F.count_if(F.col("amount_base").isNull()).alias("missing_fx"),
    )


def npv(flows: Column, rate: Column) -> Column:
    """Net present value, act/365, of an array of (days, amount)."""
    term = lambda f: f["amount"] / F.pow(rate + 1.0, f["days"] / 365.0)
    return F.aggregate(flows, F.lit(0.0), lambda acc, f: acc + term(f))


def _bisect(flows: Column) -> Column:
    """Root of the net present value in the bracket, or NULL."""
    low, high = F.lit(RATE_LOW), F.lit(RATE_HIGH)

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2.0
        probe = F.struct(mid.alias("mid"), npv(flows, mid).alias("v"))
        # evaluate the probe once: bind it through a one-element array
        return F.get(
            F.transform(
                F.array(probe),
                lambda p: F.struct(
                    F.when(F.signum(p["v"]) == s["sign"], p["mid"]).otherwise(s["lo"]).alias("lo"),
                    F.when(F.signum(p["v"]) == s["sign"], s["hi"]).otherwise(p["mid"]).alias("hi"),
                    s["sign"].alias("sign"),
                    F.coalesce(
                        s["root"],
                        F.when((F.abs(p["v"]) < NPV_STOP) | (s["hi"] - s["lo"] < WIDTH_STOP), p["mid"]),
                    ).alias("root"),
                ),
            ),
            F.lit(0),
        )

    start = F.struct(
        low.alias("lo"), high.alias("hi"), F.signum("f_low").alias("sign"), F.lit(None).cast("double").alias("root")
    )
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(HALVINGS)), start, step,
        lambda s: F.coalesce(s["root"], (s["lo"] + s["hi"]) / 2.0),
    )
    bad = F.isnan("f_low") | F.isnan("f_high")
    inf = F.lit(float("inf"))
    both = (F.abs("f_low") == inf) & (F.abs("f_high") == inf)
    return (
        F.when(bad | both, F.lit(None).cast("double")).when(F.col("f_low") == 0, low).when(F.col("f_high") == 0, high)
        .when(F.signum("f_low") != F.signum("f_high"), found)
    )


def xirr(flows: DataFrame, *, min_days: int = MIN_DAYS) -> DataFrame:
    """Money-weighted return per portfolio from (portfolio_id, date, amount)."""
    usable = flows.where(finite("amount").isNotNull() & F.col("date").isNotNull())
    daily = usable.groupBy("portfolio_id", "date").agg(
        exact_sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("amount") < 0).alias("neg"), F.bool_or(F.col("amount") > 0).alias("pos"),
    )
    per = daily.groupBy("portfolio_id").agg(
        F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("days_flows"),
        F.min("date").alias("d0"), F.max("date").alias("d1"), F.sum("n").alias("n_flows"),
        F.bool_or("neg").alias("neg"), F.bool_or("pos").alias("pos"),
    )
    vector = F.transform(
        "days_flows", lambda f: F.struct(F.datediff(f["date"], F.col("d0")).cast("double").alias("days"), f["amount"].alias("amount"))
    )
    answerable = (F.col("n_flows") >= 2) & (F.datediff("d1", "d0") >= min_days) & F.col("neg") & F.col("pos")
    rows = per.select("portfolio_id", "n_flows", answerable.alias("answerable"), vector.alias("flows"))
    rows = rows.withColumns(
        {"f_low": npv(F.col("flows"), F.lit(RATE_LOW)), "f_high": npv(F.col("flows"), F.lit(RATE_HIGH))}
    )
    return rows.select("portfolio_id", "n_flows", F.when(F.col("answerable"), _bisect(F.col("flows"))).alias("xirr"))


def period_flows(contributions: DataFrame, periods: DataFrame) -> DataFrame:
    """Flow vector of a period: -opening value, -contributions inside it, +closing value.

    `periods`: portfolio_id, start, end, value_start, value_end.
    """
    opening = periods.select("portfolio_id", F.col("start").alias("date"), (-F.col("value_start")).alias("amount"))
    closing = periods.select("portfolio_id", F.col("end").alias("date"), F.col("value_end").alias("amount"))
    inside = (
        contributions.join(periods.select("portfolio_id", "start", "end"), "portfolio_id")
        .where(F.col("date").between(F.col("start"), F.col("end")))
        .select("portfolio_id", "date", (-F.col("amount")).alias("amount"))
    )
    return opening.unionByName(inside).unionByName(closing)


def lifetime_xirr(flows: DataFrame, market_values: DataFrame, as_of: str) -> DataFrame:
    """XIRR (in %) of all external flows plus today's value; NULL if any flow has no rate."""
    state = invested(flows).join(market_values, "portfolio_id")
    fit = state.where((F.col("missing_fx") == 0) & (F.col("market_value_base") > 0))
    signed = flows.join(fit.select("portfolio_id"), "portfolio_id", "left_semi").select(
        "portfolio_id", "date", (-F.col("amount_base")).alias("amount")
    )
    closing = fit.select("portfolio_id", F.lit(as_of).cast("date").alias("date"), F.col("market_value_base").alias("amount"))
    rate = xirr(signed.unionByName(closing))
    return state.select("portfolio_id").join(
        rate.select("portfolio_id", (F.col("xirr") * 100).alias("xirr_pct")), "portfolio_id", "left"
    )


def modified_dietz(flows: DataFrame, periods: DataFrame, *, with_start: bool = True) -> DataFrame:
    """Period return per portfolio; without a start every flow weighs one half.

    `periods`: portfolio_id, start, days, value_begin, value_end.
    """
    daily = flows.groupBy("portfolio_id", "date").agg(exact_sum("amount").alias("amount"))
    rows = periods.join(daily, "portfolio_id", "left")
    elapsed = F.datediff("date", "start") if with_start else F.col("days") / 2.0
    weight = clamp((F.col("days") - elapsed) / F.col("days"), 0.0, 1.0)
    agg = rows.where(F.col("days") > 0).groupBy("portfolio_id", "days", "value_begin", "value_end").agg(
        F.coalesce(exact_sum("amount"), F.lit(0.0)).alias("net_flow"),
        F.coalesce(exact_sum(F.col("amount") * weight), F.lit(0.0)).alias("weighted"),
    )
    base = F.col("value_begin") + F.col("weighted")
    r = F.when(~is_zero(base), (F.col("value_end") - F.col("value_begin") - F.col("net_flow")) / base)
    out = periods.join(agg.select("portfolio_id", finite(r).alias("dietz")), "portfolio_id", "left")
    return out.select("portfolio_id", "days", "dietz", annualize(F.col("dietz"), F.col("days")).alias("dietz_annual"))


def annualize(period_return: Column, days: Column) -> Column:
    """Yearly rate, only for at least a year and above -100 %."""
    return F.when((days >= 365) & (period_return > -1), finite(F.pow(period_return + 1.0, F.lit(365.0) / days) - 1.0))


def twr_index(values: DataFrame, flows: DataFrame) -> DataFrame:
    """Daily-chained time-weighted index, 100 on the first valuation day.

    Inflows count at the start of the first valuation day on or after their
    date, outflows at its end; a zero base restarts the chain.
    """
    daily = (
        flows.where(finite("amount").isNotNull() & (F.col("amount") != 0))
        .groupBy("portfolio_id", "date")
        .agg(
            exact_sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("inflow"),
            exact_sum(F.when(F.col("amount") < 0, -F.col("amount"))).alias("outflow"),
        )
    )
    days = values.select("portfolio_id", "date", F.col("value").cast("double").alias("value"))
    both = days.join(daily, ["portfolio_id", "date"], "full_outer")
    back = W.partitionBy("portfolio_id").orderBy(F.col("date").desc()).rowsBetween(W.unboundedPreceding, 0)
    valued = F.when(F.col("value").isNotNull(), F.col("date"))
    aligned = both.withColumn("day", F.last(valued, ignorenulls=True).over(back)).where(F.col("day").isNotNull())
    steps = aligned.groupBy("portfolio_id", F.col("day").alias("date")).agg(
        F.max("value").alias("value"), F.coalesce(exact_sum("inflow"), F.lit(0.0)).alias("inflow"),
        F.coalesce(exact_sum("outflow"), F.lit(0.0)).alias("outflow"),
    )
    w = W.partitionBy("portfolio_id").orderBy("date")
    base = F.col("prev") + F.col("inflow")
    steps = steps.withColumn("prev", F.lag("value").over(w))
    steps = steps.withColumn("restart", F.coalesce(is_zero(base), F.lit(False)))
    factor = F.when(F.col("prev").isNull() | F.col("restart"), F.lit(1.0)).otherwise((F.col("value") + F.col("outflow")) / base)
    steps = steps.withColumn("factor", factor)
    level = F.product("factor").over(w.rowsBetween(W.unboundedPreceding, 0))
    return steps.select("portfolio_id", "date", "value", "inflow", "outflow", "restart", (level * 100.0).alias("index"))


def twr(index: DataFrame) -> DataFrame:
    """Cumulative and annualised time-weighted return; NULL below two valuations."""
    agg = index.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("points"), F.datediff(F.max("date"), F.min("date")).alias("days"),
        (F.max_by("index", "date") / 100.0 - 1.0).alias("r"), F.count_if("restart").alias("restarts"),
    )
    r = F.when(F.col("points") >= 2, F.col("r"))
    return agg.select("portfolio_id", "days", "restarts", r.alias("twr"), annualize(r, F.col("days")).alias("twr_annual"))


def drawdowns(index: DataFrame) -> DataFrame:
    """Episodes under the running peak of an index, with recovery and duration."""
    w = W.partitionBy("portfolio_id").orderBy("date")
    rows = index.where(finite("index").isNotNull()).select("portfolio_id", "date", "index")
    peak = F.max("index").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("at_peak", F.when(F.coalesce(F.col("index") >= peak, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("at_peak").over(w.rowsBetween(W.unboundedPreceding, 0)))
    low = F.when(F.col("at_peak") == 0, F.struct("index", "date"))
    runs = rows.groupBy("portfolio_id", "run").agg(
        F.min("date").alias("peak_date"), F.min_by("index", "date").alias("peak_index"), F.max("date").alias("last_date"),
        F.min(low).alias("low"),
    )
    by_run = W.partitionBy("portfolio_id").orderBy("run")
    # a run is a peak with what lies below it; the next peak ends it
    last = F.max("last_date").over(W.partitionBy("portfolio_id"))
    runs = runs.withColumns({"recovery_date": F.lead("peak_date").over(by_run), "series_end": last})
    runs = runs.where(F.col("low").isNotNull())
    return runs.select(
        "portfolio_id", "peak_date", "peak_index", F.col("low.date").alias("trough_date"), F.col("low.index").alias("trough_index"),
        (F.col("low.index") / F.col("peak_index") - 1.0).alias("depth"), "recovery_date",
        F.datediff("recovery_date", "peak_date").alias("duration_days"), F.col("recovery_date").isNull().alias("ongoing"),
        F.datediff(F.coalesce("recovery_date", "series_end"), F.col("peak_date")).alias("span_days"),
    )


def max_drawdown(episodes: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Deepest and longest episode per portfolio (earliest wins ties); depth 0 without one."""
    agg = episodes.groupBy("portfolio_id").agg(
        F.min(F.struct("depth", "peak_date", "trough_date")).alias("worst"),
        F.max_by("peak_date", F.struct("span_days", -F.datediff("peak_date", F.lit("1970-01-01").cast("date")))).alias("longest_peak"),
        F.max("span_days").alias("longest_days"), F.count(F.lit(1)).alias("episodes"),
    )
    return portfolios.select("portfolio_id").distinct().join(agg, "portfolio_id", "left").select(
        "portfolio_id", F.coalesce("worst.depth", F.lit(0.0)).alias("depth"), F.col("worst.peak_date").alias("worst_peak"),
        F.col("worst.trough_date").alias("worst_trough"), "longest_peak", "longest_days",
        F.coalesce("episodes", F.lit(0)).alias("episodes"),
    )
