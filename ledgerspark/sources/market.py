"""Landed market-data payloads (JSON text per row) to rates, quotes and dividend profiles.

Whoever fetches lands the bodies as files; here they are only normalised.  A
payload that does not have the expected shape is rejected with a reason, never
read as "nothing there".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.coerce import as_boolean, as_currency, as_iso_date, as_number, as_string
from ledgerspark.operators.quotes import dominant_currency

# Key spellings seen in dividend payloads, in order of preference.
ROW_CONTAINERS = ["list", "data", "dividends", "dividendData", "table", "rows"]
EX_DATE_KEYS = ["exDate", "ex_date", "ex", "dt", "date"]
PAY_DATE_KEYS = ["payDate", "pay_date", "paymentDate", "payment_date", "pay"]
AMOUNT_KEYS = ["amount", "adjDividend", "dividend", "dps", "value", "v"]
# Folded German labels of policies, intervals and months, and converted-amount columns.
POLICIES = {"ausschuttend": "distributing", "ausschuttungen": "distributing", "thesaurierend": "accumulating", "thesaurierung": "accumulating"}
INTERVALS = {
    "monatlich": 12, "zweimonatlich": 6, "vierteljahrlich": 4, "quartalsweise": 4, "halbjahrlich": 2, "jahrlich": 1, "keineausschuttung": 0, "keine": 0,
}
MONTH_NAMES = ["januar", "februar", "marz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]
CONVERTED = {"total_in_eur": "EUR", "total_in_gbp": "GBP", "total_in_usd": "USD"}

_MAP = T.MapType(T.StringType(), T.StringType())


def _get(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def _map(text: Column) -> Column:
    """JSON object as a map of raw texts."""
    return F.from_json(text, _MAP)


def fx_range(payloads: DataFrame) -> DataFrame:
    """`{base, rates: {date: {currency: rate}}}` bodies to (base, quote, date, rate)."""
    base = as_currency(_get(F.col("body"), "$.base"))
    days = payloads.select(base.alias("base"), F.explode(_map(_get(F.col("body"), "$.rates"))).alias("day", "inner"))
    days = days.where(F.col("base").isNotNull() & F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    rows = days.select("base", as_iso_date(F.col("day")).alias("date"), F.explode(_map(F.col("inner"))).alias("code", "value"))
    return _clean_rates(rows.select("base", as_currency(F.col("code")).alias("quote"), "date", as_number(F.col("value")).alias("rate")))


def fx_snapshot(payloads: DataFrame) -> DataFrame:
    """`{base, date, amount, rates}` bodies: the echoed date counts, rates are per one unit."""
    b = F.col("body")
    amount = as_number(_get(b, "$.amount"))
    rows = payloads.select(
        as_currency(_get(b, "$.base")).alias("base"), as_iso_date(_get(b, "$.date")).alias("date"),
        F.when(amount > 0, amount).otherwise(F.lit(1.0)).alias("amount"), F.explode(_map(_get(b, "$.rates"))).alias("code", "value"),
    )
    rows = rows.select("base", as_currency(F.col("code")).alias("quote"), "date", as_number(F.col("value")).alias("raw"), "amount")
    return _clean_rates(rows.select("base", "quote", "date", (F.col("raw") / F.col("amount")).alias("rate")))


def _clean_rates(rows: DataFrame) -> DataFrame:
    return rows.where(
        F.col("base").isNotNull() & F.col("quote").isNotNull() & F.col("date").isNotNull() & (F.col("rate") > 0) & (F.col("base") != F.col("quote"))
    )


def quotes(payloads: DataFrame) -> DataFrame:
    """Quote bodies (symbol, body, loaded_at) to prices; `reason` is set on refused ones."""
    b = F.col("body")
    status = as_number(_get(b, "$.status"))
    price, close = as_number(_get(b, "$.data.p")), as_number(_get(b, "$.data.cl"))
    stamp = F.try_to_timestamp(as_string(_get(b, "$.data.u")))
    late = stamp > F.col("loaded_at") + F.expr("interval 2 days")
    reason = (
        F.when(status.isNull(), "no status").when(status != 200, "provider status").when(_get(b, "$.data").isNull(), "no data")
        .when(price.isNull(), "no price").when(price <= 0, "non-positive price")
    )
    return payloads.select(
        *[c for c in payloads.columns if c != "body"], reason.alias("reason"), F.when(reason.isNull(), price).alias("price"),
        F.when(close > 0, close).alias("previous_close"), as_string(_get(b, "$.data.ex")).alias("exchange"),
        F.coalesce(as_currency(_get(b, "$.data.c")), as_currency(_get(b, "$.data.currency"))).alias("currency"),
        F.when(stamp.isNull() | late, F.col("loaded_at")).otherwise(stamp).alias("as_of"),
    )


def _first_of(row: Column, keys: list[str]) -> Column:
    """Value of the first key the object has at all, even if that value is unusable."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(row, k), row[k]).otherwise(out)
    return out


def _array(text: Column) -> Column:
    return F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, T.ArrayType(T.StringType())))


def dividends(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dividend bodies (instrument_key, body, fallback_currency) to (payments, rejects)."""
    b = F.col("body")
    status = as_number(_get(b, "$.status"))
    data = _get(b, "$.data")
    rows = F.coalesce(_array(data), *[_array(_get(b, f"$.data.{k}")) for k in ROW_CONTAINERS])
    reason = F.when(status.isNull(), "no status").when(status != 200, "provider status").when(rows.isNull(), "no row array")
    read = payloads.withColumns({"reason": reason, "rows": rows})
    row = _map(F.col("r"))
    found = read.where(F.col("reason").isNull()).withColumn("r", F.explode("rows"))
    out = found.select(
        *[c for c in payloads.columns if c not in ("body", "fallback_currency")], as_iso_date(_first_of(row, EX_DATE_KEYS)).alias("ex_date"),
        as_iso_date(_first_of(row, PAY_DATE_KEYS)).alias("pay_date"), as_number(_first_of(row, AMOUNT_KEYS)).alias("amount"),
        F.coalesce(as_currency(row["currency"]), as_currency(row["cur"]), F.col("fallback_currency")).alias("currency"), F.lit(True).alias("declared"),
    )
    good = out.where(F.col("ex_date").isNotNull() & (F.col("amount") > 0) & F.col("currency").isNotNull())
    return good, read.where(F.col("reason").isNotNull()).drop("body", "rows")


def fold_label(x: Column) -> Column:
    """Umlauts and their transliterations, case and punctuation folded away."""
    t = F.translate(F.lower(as_string(x)), "äöüéèà", "aoueea")
    for old, new in (("ß", "ss"), ("ae", "a"), ("oe", "o"), ("ue", "u")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, "[^a-z]", "")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[key]


def distribution_policy(x: Column) -> Column:
    return _lookup(POLICIES, fold_label(x))


def payments_per_year(x: Column) -> Column:
    return _lookup(INTERVALS, fold_label(x))


def month_index(x: Column) -> Column:
    return _lookup({m: i + 1 for i, m in enumerate(MONTH_NAMES)}, fold_label(x))


def growth_map(text: Column) -> Column:
    """`{"year_5": x}` re-keyed to `{"5": x}`; entries that are not numbers go."""
    numbers = F.transform_values(_map(text), lambda _, v: as_number(v))
    kept = F.map_filter(numbers, lambda _, v: v.isNotNull())
    renamed = F.transform_keys(kept, lambda k, _: F.regexp_replace(k, r"^year_(\d{1,2})$", "$1"))
    return F.when(F.size(renamed) > 0, renamed)


def schedule_in_force(text: Column, as_of: str) -> Column:
    """Payments per year of the latest schedule that has started: its name, else its month count."""
    entry = T.StructType([T.StructField("name", T.StringType()), T.StructField("start_date", T.StringType()), T.StructField("months", T.ArrayType(T.StringType()))])
    rows = F.from_json(text, T.ArrayType(entry))
    staged = F.transform(
        rows,
        lambda e: F.struct(
            F.coalesce(as_iso_date(e["start_date"]), F.lit("0001-01-01").cast("date")).alias("start"),
            F.coalesce(payments_per_year(e["name"]), F.when(F.size(e["months"]).between(1, 12), F.size(e["months"]))).alias("per_year"),
        ),
    )
    usable = F.filter(staged, lambda e: (e["start"] <= F.lit(as_of).cast("date")) & e["per_year"].isNotNull())
    return F.array_max(usable)["per_year"]


def fund_details(payloads: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fund bodies (instrument_key, body) to (profiles, payments, rejects).

    Payments of accumulating funds are dropped.  A payment names its currency or
    equals exactly one converted amount; the others are restated in the fund's
    most common currency.
    """
    b = F.col("body")
    first = F.coalesce(_get(b, "$.results[0]"), F.when(F.startswith(_get(b, "$.data"), F.lit("{")), _get(b, "$.data")), b)
    keep = [c for c in payloads.columns if c != "body"]
    read = payloads.withColumn("d", first)
    d = F.col("d")
    flag = as_boolean(_get(d, "$.is_distributing"))
    policy = distribution_policy(F.coalesce(_get(d, "$.distribution_policy"), _get(d, "$.distribution_type")))
    read = read.withColumn("is_distributing", F.coalesce(flag, policy == "distributing"))
    rejects = read.where(F.col("is_distributing").isNull()).select(*keep, F.lit("no distributing flag and no policy").alias("reason"))
    known = read.where(F.col("is_distributing").isNotNull())

    years = known.where("is_distributing").select(*keep, F.explode(_map(_get(d, "$.distribution_frequency_months"))).alias("year", "list"))
    rows = years.select(*keep, F.explode(_array(F.col("list"))).alias("r")).withColumn("m", _map(F.col("r")))
    m = F.col("m")
    amount = as_number(m["total_in_tc"])
    explicit = F.coalesce(*[as_currency(m[k]) for k in ("currency", "trading_currency", "distribution_currency")])
    same = F.array_compact(
        F.array(*[F.when((amount != 0) & (F.abs(as_number(m[k]) - amount) <= F.abs(amount) * 1e-9), F.lit(c)) for k, c in CONVERTED.items()])
    )
    restated = F.map_filter(
        F.create_map(*[x for k, c in CONVERTED.items() for x in (F.lit(c), as_number(m[k]))]), lambda _, v: v.isNotNull() & (v > 0)
    )
    staged = rows.select(
        *keep, as_iso_date(m["ex_date"]).alias("ex_date"), as_iso_date(m["pay_date"]).alias("pay_date"), amount.alias("own"),
        F.coalesce(explicit, F.when(F.size(same) == 1, F.get(same, F.lit(0)))).alias("named"), restated.alias("restated"),
    ).where(F.col("ex_date").isNotNull())
    clear = F.col("named").isNotNull() & (F.col("own") > 0)
    house = dominant_currency(staged.where(clear).withColumn("currency", F.col("named")), keep).withColumnRenamed("currency", "house")
    full = staged.join(house, keep, "left").withColumn("house", F.coalesce("house", F.lit("EUR")))
    payments = full.select(
        *keep, "ex_date", "pay_date", F.when(clear, F.col("own")).otherwise(F.col("restated")[F.col("house")]).alias("amount"),
        F.when(clear, F.col("named")).otherwise(F.col("house")).alias("currency"), F.lit(True).alias("declared"),
    ).where(F.col("amount").isNotNull())
    profiles = known.select(
        *keep, "is_distributing",
        F.when(F.col("is_distributing"), schedule_in_force(_get(d, "$.distribution_frequency"), as_of)).otherwise(F.lit(0)).alias("declared_frequency"),
        F.when(F.col("is_distributing"), growth_map(_get(d, "$.distribution_cagr"))).alias("cagr"),
    )
    return profiles, payments, rejects
