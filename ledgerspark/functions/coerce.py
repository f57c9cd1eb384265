"""Tolerant conversions of landed market-data values; anything unusable becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_MILLIS_FROM = 1e11


def _text(x: Column) -> Column:
    t = F.trim(x)
    return F.when(~t.isin("", "-", "--"), t)


def as_string(x: Column) -> Column:
    return _text(x)


def as_number(x: Column) -> Column:
    """Number, or text with separators."""
    v = F.regexp_replace(_text(x.cast("string")), r"[\s, ]", "").try_cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def as_boolean(x: Column) -> Column:
    t = F.lower(_text(x.cast("string")))
    n = t.try_cast("double")
    return F.when(t.isin("true", "yes"), True).when(t.isin("false", "no"), False).when(n.isNotNull(), n != 0)


def as_iso_date(x: Column) -> Column:
    """YYYY-MM-DD…, M/D/YYYY, or an epoch in seconds or milliseconds by magnitude."""
    t = _text(x.cast("string"))
    n = t.try_cast("double")
    seconds = F.when(F.abs(n) < EPOCH_MILLIS_FROM, n).otherwise(n / 1000)
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    part = lambda g: F.regexp_extract(t, us, g)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
        .when(t.rlike(us), F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd"))
        .when(F.abs(seconds) < 8.64e12, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.when(F.abs(seconds) < 8e10, seconds) / 86400).cast("int")))
    )


def as_currency(x: Column) -> Column:
    c = F.upper(_text(x))
    return F.when(c.rlike("^[A-Z]{3}$"), c)
