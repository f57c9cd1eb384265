"""Calendar helpers.  Text that is not a date becomes NULL instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_date(x) -> Column:
    """Leading YYYY-MM-DD of a text as a date, else NULL."""
    x = _c(x)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"))


def days_between(a, b) -> Column:
    return F.datediff(_c(b), _c(a))


def add_days(d, n) -> Column:
    return F.date_add(_c(d), n)


def add_months(d, n) -> Column:
    """Month arithmetic clamped to the month's last day."""
    return F.add_months(_c(d), n)


def month_ordinal(d) -> Column:
    return F.year(_c(d)) * 12 + F.month(_c(d))


def months_between(a, b) -> Column:
    """Whole months by month key; the day of the month is ignored."""
    return month_ordinal(b) - month_ordinal(a)


def first_of_month(d) -> Column:
    return F.trunc(_c(d), "month")


def month_of_year(d) -> Column:
    return F.month(_c(d))


def month_key(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def quarter_key(d) -> Column:
    d = _c(d)
    return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))


def year_key(d) -> Column:
    return F.date_format(_c(d), "yyyy")


def period_start(d, period: str) -> Column:
    return F.trunc(_c(d), period)


def period_end(start, period: str) -> Column:
    """Inclusive last day of the period that begins at `start`."""
    return F.date_sub(F.add_months(_c(start), PERIOD_MONTHS[period]), 1)


def period_key(d, period: str) -> Column:
    return {"month": month_key, "quarter": quarter_key, "year": year_key}[period](d)


def period_series(first, last, period: str) -> Column:
    """Array of period starts covering [first, last]."""
    step = F.expr(f"interval {PERIOD_MONTHS[period]} month")
    return F.sequence(period_start(first, period), period_start(last, period), step)
