"""Currency conversion: dense as-of rate tables, inverses, pivots, merge policy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.numeric import finite
from ledgerspark.operators.scan import cut_lineage

MAX_STALE_DAYS = 10
# Pivot currencies tried before all others.
PIVOTS = ("EUR", "USD")
# Currencies the central-bank feed publishes.
SUPPORTED = (
    "AUD BRL CAD CHF CNY CZK DKK EUR GBP HKD HUF IDR ILS INR ISK "
    "JPY KRW MXN MYR NOK NZD PHP PLN RON SEK SGD THB TRY USD ZAR"
).split()

BROADCAST_ROWS = 5_000_000


def usable_rates(rates: DataFrame) -> DataFrame:
    """Drop rates that are not positive finite numbers."""
    r = finite("rate")
    return rates.where(r.isNotNull() & (r > 0) & (F.col("base") != F.col("quote")))


def merge_rates(*sources: DataFrame) -> DataFrame:
    """One rate per (base, quote, date); earlier arguments take precedence.

    Sources may name the portfolio whose statements state the rate; rates of the others, which hold for
    all, then have none.
    """
    owned = any("portfolio_id" in s.columns for s in sources)
    cols = [*(["portfolio_id"] if owned else []), "base", "quote", "date"]
    nobody = F.lit(None).cast("string").alias("portfolio_id")
    parts = [
        s.select(*[nobody if c not in s.columns else F.col(c).cast("string").alias(c) if c == "portfolio_id" else F.col(c) for c in cols], "rate", F.lit(i).alias("_rank"))
        for i, s in enumerate(sources)
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*cols).agg(F.min(F.struct("_rank", "rate")).alias("_best")).select(*cols, F.col("_best.rate").alias("rate"))


def dense_direct(rates: DataFrame, max_stale: int = MAX_STALE_DAYS, by: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, day) -> the last published rate, forward pair before inverse; apart for each `by`.

    Each rate is repeated for the days it is in force, which turns the backward
    as-of lookup into a plain equi join.
    """
    nxt = F.lead("date").over(W.partitionBy(*by, "base", "quote").orderBy("date"))
    held = usable_rates(rates).withColumn("_next", nxt)
    last = F.least(F.date_sub("_next", 1), F.date_add("date", max_stale))
    daily = held.withColumn("day", F.explode(F.sequence("date", last)))
    legs = F.array(
        F.struct(F.col("base").alias("src"), F.col("quote").alias("dst"), F.lit(0).alias("side"), F.col("rate")),
        F.struct(F.col("quote").alias("src"), F.col("base").alias("dst"), F.lit(1).alias("side"), (1.0 / F.col("rate")).alias("rate")),
    )
    both = daily.select(*by, "day", "date", F.explode(legs).alias("leg")).select(*by, "day", "date", "leg.*")
    return (
        both.groupBy(*by, "src", "dst", "day")
        .agg(F.min(F.struct("side", "rate", "date")).alias("_m"))
        .select(*by, "src", "dst", "day", F.col("_m.rate").alias("rate"), F.col("_m.date").alias("rate_date"))
    )


@dataclass
class RateTable:
    """Resolved rates (src, dst, day, rate, rate_date, via) into the target currencies.

    `own` holds rates of single portfolios, which count for their rows where the shared ones have none.
    """

    df: DataFrame
    small: bool
    own: RateTable | None = None

    def side(self) -> DataFrame:
        return F.broadcast(self.df) if self.small else self.df


def resolve_rates(
    rates: DataFrame,
    targets: list[str],
    *,
    max_stale: int = MAX_STALE_DAYS,
    via: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> RateTable:
    """Direct or pivoted rate of every (currency, target, day).

    The table holds (currencies x targets x days) rows however large the facts
    are; it is counted once and broadcast only below `broadcast_rows`.  Rates that
    name a portfolio are resolved, and crossed, inside it.
    """
    if "portfolio_id" not in rates.columns:
        return _resolve(rates, targets, max_stale, via, broadcast_rows, ())
    owner = F.col("portfolio_id")
    shared = _resolve(rates.where(owner.isNull()), targets, max_stale, via, broadcast_rows, ())
    shared.own = _resolve(rates.where(owner.isNotNull()), targets, max_stale, via, broadcast_rows, ("portfolio_id",))
    return shared


def _resolve(rates: DataFrame, targets: list[str], max_stale: int, via: str | None, broadcast_rows: int, by: tuple[str, ...]) -> RateTable:
    direct = dense_direct(rates, max_stale, by)
    into = F.col("dst").isin(*targets)
    order = F.when(F.col("via") == F.lit(via), 0) if via else F.lit(None).cast("int")
    order = F.coalesce(
        order,
        F.when(F.col("via") == PIVOTS[0], 1).when(F.col("via") == PIVOTS[1], 2).otherwise(3),
    )
    first = direct.select(*by, F.col("src"), F.col("dst").alias("via"), "day", F.col("rate").alias("r1"), F.col("rate_date").alias("d1"))
    second = direct.where(into).select(
        *by, F.col("src").alias("via"), "dst", "day", F.col("rate").alias("r2"), F.col("rate_date").alias("d2")
    )
    crossed = (
        first.join(second, [*by, "via", "day"])
        .where(F.col("src") != F.col("dst"))
        .select(
            *by, "src", "dst", "day", order.alias("pref"), "via",
            (F.col("r1") * F.col("r2")).alias("rate"), F.least("d1", "d2").alias("rate_date"),
        )
    )
    straight = direct.where(into).select(
        *by, "src", "dst", "day", F.lit(-1).alias("pref"), F.lit(None).cast("string").alias("via"), "rate", "rate_date"
    )
    best = (
        straight.unionByName(crossed)
        .groupBy(*by, "src", "dst", "day")
        .agg(F.min(F.struct("pref", "via", "rate", "rate_date")).alias("_b"))
        .select(*by, "src", "dst", "day", "_b.rate", "_b.rate_date", "_b.via")
    )
    best = cut_lineage(best)
    return RateTable(best, best.count() <= broadcast_rows)


def _looked_up(tagged: DataFrame, table: RateTable, name: str) -> DataFrame:
    """Add struct `name` (rate, rate_date, via) found for _q_src, _q_dst, _q_day and, where the table tells them apart, portfolio_id."""
    owned = "portfolio_id" in table.df.columns
    keys = {"src": "_q_src", "dst": "_q_dst", "day": "_q_day"}
    look = table.df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct("rate", "rate_date", "via").alias(name), *([F.col("portfolio_id").alias("_k_owner")] if owned else []))
    look = F.broadcast(look) if table.small else look
    on = reduce(Column.__and__, [F.col(q) == F.col(f"_k_{k}") for k, q in keys.items()])
    if owned:
        on = on & (F.col("portfolio_id").cast("string") == F.col("_k_owner").cast("string"))
    return tagged.join(look, on, "left").drop("_k_src", "_k_dst", "_k_day", "_k_owner")


def with_rate(
    df: DataFrame,
    src: Column | str,
    dst: Column | str,
    day: Column | str,
    table: RateTable,
    *,
    rate: str = "rate",
    rate_date: str | None = None,
    via: str | None = None,
) -> DataFrame:
    """Add the rate from `src` to `dst` in force on `day` (NULL when unknown); rows without a portfolio_id get shared rates only."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    hit = _looked_up(df.withColumns({"_q_src": c(src), "_q_dst": c(dst), "_q_day": c(day)}), table, "_fx")
    if table.own is not None and "portfolio_id" in df.columns:
        hit = _looked_up(hit, table.own, "_own")
        # all three from one table
        hit = hit.withColumn("_fx", F.when(F.col("_fx.rate").isNotNull(), F.col("_fx")).otherwise(F.col("_own"))).drop("_own")
    same = F.col("_q_src") == F.col("_q_dst")
    out = {rate: F.when(same, F.lit(1.0)).otherwise(F.col("_fx.rate"))}
    if rate_date:
        out[rate_date] = F.when(same, F.col("_q_day")).otherwise(F.col("_fx.rate_date"))
    if via:
        out[via] = F.when(~same, F.col("_fx.via"))
    return hit.withColumns(out).drop("_q_src", "_q_dst", "_q_day", "_fx")


def convert(
    df: DataFrame,
    amounts: dict[str, str],
    src: Column | str,
    dst: Column | str,
    day: Column | str,
    table: RateTable,
    *,
    rate: str | None = None,
    rate_date: str | None = None,
    via: str | None = None,
) -> DataFrame:
    """Add converted amounts, `amounts` mapping new column -> source column."""
    out = with_rate(df, src, dst, day, table, rate="_rate", rate_date=rate_date, via=via)
    out = out.withColumns({new: finite(old) * F.col("_rate") for new, old in amounts.items()})
    return out.withColumnRenamed("_rate", rate) if rate else out.drop("_rate")


def required_currencies(
    transactions: DataFrame, positions: DataFrame, instruments: DataFrame, settings: DataFrame, as_of: str
) -> DataFrame:
    """Currencies each portfolio touches and the date range rates are needed for."""
    used = (
        transactions.select("portfolio_id", "currency")
        .unionByName(positions.select("portfolio_id", "currency"))
        .unionByName(instruments.select("portfolio_id", F.col("trade_currency").alias("currency")))
        .unionByName(instruments.select("portfolio_id", F.col("div_currency").alias("currency")))
        .where(F.col("currency").isNotNull() & (F.col("currency") != ""))
        .distinct()
    )
    start = transactions.groupBy("portfolio_id").agg(F.min("date").alias("_from"))
    day = F.lit(as_of).cast("date")
    return (
        used.join(settings.select("portfolio_id", "base_currency"), "portfolio_id")
        .where(F.col("currency") != F.col("base_currency"))
        .join(start, "portfolio_id", "left")
        .select(
            "portfolio_id", "base_currency", "currency",
            F.least(F.coalesce("_from", day), day).alias("date_from"), day.alias("date_to"),
        )
    )


def unsupported_currencies(required: DataFrame) -> DataFrame:
    """Required currencies the feed does not publish."""
    return required.where(~F.upper(F.trim("currency")).isin(*SUPPORTED))
