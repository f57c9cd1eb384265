"""Ledger-shaped views over the star-schema tables, used by the query bank.

Built from integers and plain double arithmetic only, so any SQL engine gets the
same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Amounts are divided by a prime-based factor so that no rounded result sits on a tie.
OFF_TIE = 0.9973
CURRENCIES = ["USD", "EUR", "GBP", "CHF", "JPY"]
AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _currency(n) -> F.Column:
    return F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (n % 5 + 1).cast("int"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity")
    ident = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", qty.cast("long"),
        F.round(F.col("l_extendedprice") * 100).cast("long"),
    )
    key = F.col("l_partkey") % 20
    return li.select(
        F.col("l_suppkey").alias("portfolio_id"), key.alias("instrument_key"), ident.alias("id"),
        F.col("l_shipdate").alias("ts"), F.to_date("l_shipdate").alias("date"), _currency(key).alias("currency"),
        F.when(F.col("l_returnflag") == "R", -qty).otherwise(qty).alias("quantity"),
        (F.col("l_extendedprice") / qty / F.lit(OFF_TIE)).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax") / 100.0 / F.lit(OFF_TIE)).alias("fees"),
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday rates of three one-directional pairs; JPY is absent on purpose."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    rate = lambda x: F.lit(0.5) + (x % 1000) / F.lit(1000.0)
    pair = lambda b, q, x: F.struct(F.lit(b).alias("base"), F.lit(q).alias("quote"), rate(F.col(x)).alias("rate"))
    legs = F.array(pair("USD", "EUR", "lo"), pair("USD", "GBP", "hi"), pair("EUR", "CHF", "n"))
    return o.where(F.weekday("date") < 5).select("date", F.explode(legs).alias("p")).select("p.base", "p.quote", "date", "p.rate")


def settings(portfolios: DataFrame) -> DataFrame:
    """EUR for even portfolios, USD for odd ones; every third one uses average cost."""
    p = F.col("portfolio_id")
    return portfolios.select("portfolio_id").distinct().select(
        "portfolio_id", F.when(p % 2 == 0, "EUR").otherwise("USD").alias("base_currency"),
        F.when(p % 3 == 0, "AVERAGE").otherwise("FIFO").alias("cost_basis_method"),
    )


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_custkey") % 20
    pay = F.to_date("o_orderdate")
    gross = F.col("o_totalprice") / F.lit(OFF_TIE)
    tax = F.when(F.col("o_custkey") % 2 == 0, gross * 15.0 / 100.0).otherwise(F.lit(0.0))
    linked = F.col("o_orderkey") % 7 != 0
    return o.select(
        (F.col("o_custkey") % 100).alias("portfolio_id"), F.when(linked, key).alias("instrument_key"),
        F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("ISIN"), key.cast("string"))).alias("isin"),
        F.col("o_orderkey").alias("id"), pay.alias("pay_date"),
        F.when(F.col("o_orderstatus") != "P", F.date_sub(pay, (F.col("o_orderkey") % 45).cast("int"))).alias("ex_date"),
        _currency(key).alias("currency"), gross.alias("gross"), tax.alias("tax"), (gross - tax).alias("net"),
        ((F.col("o_orderkey") % 100 + 1) / F.lit(100.0)).alias("per_share"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Return of Capital").when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).otherwise("Ordinary Dividend").alias("div_type"),
        F.lit("Cash Dividend").alias("description"),
    )


def cash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        (F.col("o_custkey") % 100).alias("portfolio_id"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"),
        F.when(st == "F", "DEPOSIT").when(st == "O", "WITHDRAWAL").otherwise("INTEREST").alias("kind"),
        (F.when(st == "O", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")) / F.lit(OFF_TIE)).alias("amount"),
        _currency(F.col("o_custkey") % 4).alias("currency"),
    )


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5000 plus the running daily sum of event values, negative for some types."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_type").isin("error", "click"), -F.col("value")).otherwise(F.col("value"))
    daily = e.where(F.col("event_type") != "signup").groupBy(F.col("user_id").alias("portfolio_id"), F.to_date("ts").alias("date")).agg(
        F.sum(F.round(v * 100).cast("long")).alias("cents")
    )
    run = F.sum("cents").over(W.partitionBy("portfolio_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return daily.select("portfolio_id", "date", (F.lit(5000.0) + run / F.lit(100.0)).alias("value"))


def flow_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    day = F.to_date("ts")
    sign = F.when(F.col("event_id") % 5 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return e.select(
        F.col("user_id").alias("portfolio_id"),
        F.when(F.col("event_id") % 3 == 0, F.date_sub(day, 1)).otherwise(day).alias("date"), (F.col("value") * sign).alias("amount"),
    )


def quotes_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("instrument_key"), F.col("event_id").alias("seq"), F.col("ts").alias("as_of"),
        F.col("value").alias("price"), F.lit("USD").alias("currency"),
    )


def quote_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes in order of arrival, with what a gate must refuse: late, in another unit or currency, without one, not positive."""
    e = table(spark, sf_dir, "events")
    n, user, ts = F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp")
    own = F.when(user % 3 == 0, "USD").when(user % 3 == 1, "EUR").otherwise("GBP")
    price = (F.lit(50.0) + F.col("value") / 2) * F.when(n % 41 == 0, 100.0).when(n % 53 == 0, -1.0).otherwise(1.0)
    stated = user % 5 < 2
    return e.select(
        user.alias("instrument_key"), n.alias("seq"), F.when(n % 7 == 0, ts + F.expr("INTERVAL 3 DAYS")).otherwise(ts).alias("arrived_at"),
        F.when(n % 101 != 0, ts).alias("as_of"), price.alias("price"),
        F.when(n % 31 == 0, "CHF").when(n % 59 == 0, "").when(n % 2 == 0, F.lower(own)).otherwise(own).alias("currency"),
        F.when(user % 4 == 1, own).alias("expected_currency"), F.when(stated, 60.0 + user % 40).alias("statement_price"),
        F.when(stated & (user % 2 == 0), own).alias("statement_currency"), F.when(stated, F.lit("2024-01-15").cast("timestamp")).alias("statement_as_of"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of sources: events as fetches of which a small value is a success."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (F.col("value") < 25).alias("ok"), F.col("event_type").alias("error"),
    )


def listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(instruments, overrides) made of parts: several venues, renamed tickers, some without currency, overridden or excluded."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(
        (k % 100).alias("portfolio_id"), k.alias("instrument_key"), F.concat(F.lit("P"), k.cast("string"), F.when(k % 5 == 0, "x").otherwise("")).alias("symbol"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("Q"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(k % 4 == 0, "AEB").when(k % 4 == 1, "NYSE").when(k % 4 == 2, "LSEETF").otherwise("MOON").alias("listing_exchange"),
        F.when(k % 50 == 7, "Cash").otherwise("Stocks").alias("asset_category"), F.when(k % 6 != 0, "USD").alias("trade_currency"),
        F.when(k % 3 != 1, F.col("p_retailprice")).alias("close_price"),
        F.when(k % 11 == 0, F.concat(F.lit("swx-p"), k.cast("string"))).alias("provider_symbol"), (k % 97 == 0).alias("excluded"), F.lit(None).cast("string").alias("manual_price_currency"),
    )
    return t.drop("provider_symbol", "excluded", "manual_price_currency"), t.select("portfolio_id", "instrument_key", "provider_symbol", "excluded", "manual_price_currency")


#: Forms of symbols that quotes landed for; form i fails for parts where key div (i + 2) is even.
LANDED_FORMS = [("P", ""), ("P", "X"), ("AMS-P", ""), ("AMS-Q", ""), ("Q", ""), ("LON-P", ""), ("SWX-P", "")]


def landed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed answers for some symbols of each part; London's are in pence and without a currency."""
    k = F.col("p_partkey")
    forms = F.array(*[
        F.struct(
            F.concat(F.lit(head), k.cast("string"), F.lit(tail)).alias("symbol"), F.when(F.floor(k / (i + 2)) % 2 == 0, "provider status").alias("reason"),
            (F.col("p_retailprice") * (100.0 if head == "LON-P" else 1.0)).alias("price"), F.lit(None if head == "LON-P" else "EUR").cast("string").alias("currency"),
        )
        for i, (head, tail) in enumerate(LANDED_FORMS)
    ])
    rows = table(spark, sf_dir, "part").select(F.explode(forms).alias("f")).select("f.*")
    return rows.withColumns({"previous_close": F.lit(None).cast("double"), "as_of": F.lit("2001-08-01").cast("timestamp")})


def positions(transactions: DataFrame) -> DataFrame:
    """Two year-end style snapshots of the signed ledger quantity, off by one share for some."""
    dates = F.array(F.lit("1998-06-30").cast("date"), F.lit("2000-12-31").cast("date"))
    rows = transactions.select("portfolio_id", "instrument_key", "currency", "date", "quantity", "price", F.explode(dates).alias("as_of"))
    agg = rows.where(F.col("date") <= F.col("as_of")).groupBy("portfolio_id", "instrument_key", "as_of").agg(
        F.sum("quantity").alias("q"), F.max("price").alias("close_price"), F.min("currency").alias("currency")
    )
    q = F.greatest(F.col("q"), F.lit(0.0)) + F.when(F.col("instrument_key") % 7 == 0, 1.0).otherwise(0.0)
    return agg.select(
        "portfolio_id", "instrument_key", "as_of", F.concat(F.lit("A"), (F.col("instrument_key") % 2).cast("string")).alias("account"),
        "currency", q.alias("quantity"), "close_price", (q * F.col("close_price") / 2.0).alias("cost_basis"),
    )


def instruments(transactions: DataFrame) -> DataFrame:
    key = F.col("instrument_key")
    return transactions.groupBy("portfolio_id", "instrument_key").agg(F.min("currency").alias("trade_currency")).select(
        "portfolio_id", "instrument_key", F.concat(F.lit("SYM"), key.cast("string")).alias("symbol"),
        F.concat(F.lit("Fund "), key.cast("string")).alias("name"),
        F.array(F.concat(F.lit("SYM"), key.cast("string"))).alias("aliases"), F.lit("Stocks").alias("asset_category"),
        "trade_currency", F.lit(None).cast("string").alias("div_currency"),
        F.when(key == 19, 100.0).otherwise(1.0).alias("multiplier"),
    )


def quotes(spark: SparkSession, sf_dir: str, transactions: DataFrame) -> DataFrame:
    """A quote for instruments whose key is not a multiple of three."""
    part = table(spark, sf_dir, "part")
    price = part.groupBy((F.col("p_partkey") % 20).alias("instrument_key")).agg(F.max("p_retailprice").alias("price"))
    held = transactions.groupBy("portfolio_id", "instrument_key").agg(F.min("currency").alias("currency"))
    return held.join(price, "instrument_key").where(F.col("instrument_key") % 3 != 0).select(
        "portfolio_id", "instrument_key", "price", "currency", F.lit(AS_OF).cast("timestamp_ntz").alias("as_of"), F.lit("feed").alias("source")
    )


def overrides(transactions: DataFrame) -> DataFrame:
    """A manual price for key 5 and an exclusion for key 6."""
    keys = transactions.select("portfolio_id", "instrument_key").distinct().where(F.col("instrument_key").isin(5, 6))
    five = F.col("instrument_key") == 5
    return keys.select(
        "portfolio_id", "instrument_key", F.when(five, "MANUAL5").alias("display_symbol"),
        F.when(five, F.lit(1234.5)).alias("manual_price"), F.lit(None).cast("string").alias("manual_price_currency"), (~five).alias("excluded"),
    )


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and projected per-share payments, one for each order."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_custkey") % 20
    # key 4 stopped paying years before the valuation date
    ex = F.when(key == 4, F.date_sub(F.to_date("o_orderdate"), 3650)).otherwise(F.to_date("o_orderdate"))
    return o.select(
        key.alias("instrument_key"), ex.alias("ex_date"), F.date_add(ex, (F.col("o_orderkey") % 40).cast("int")).alias("pay_date"),
        ((F.col("o_orderkey") % 100 + 1) / F.lit(100.0) / F.lit(OFF_TIE)).alias("amount"), _currency(key).alias("currency"),
        (F.col("o_orderstatus") != "P").alias("declared"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("instrument_key")).distinct()
    key = F.col("instrument_key")
    return keys.select(
        "instrument_key", _currency(key).alias("currency"), ((key != 8) & (key % 4 != 3)).alias("is_distributing"), F.lit(2.5).alias("ttm_per_share"),
    )


def accruals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net dividend accruals per supplier, instrument and day; those of some instruments in the last months are open."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey") % 20
    day = F.to_date("l_shipdate")
    agg = li.groupBy(F.col("l_suppkey").alias("portfolio_id"), key.alias("instrument_key"), day.alias("ex_date")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q")
    )
    gross = F.col("q") / F.lit(100.0) / F.lit(OFF_TIE)
    return agg.select(
        "portfolio_id", "instrument_key", "ex_date", F.date_add("ex_date", 20).alias("pay_date"), _currency(F.col("instrument_key")).alias("currency"),
        F.col("q").cast("double").alias("quantity"), F.lit(0.01).alias("gross_rate"), gross.alias("gross"), (gross / 4.0).alias("tax"),
        (gross - gross / 4.0).alias("net"), ((F.col("q") % 2 == 0) & (F.col("instrument_key") % 5 == 2) & (F.col("ex_date") >= F.lit("2001-07-01").cast("date"))).alias("open"),
    )
