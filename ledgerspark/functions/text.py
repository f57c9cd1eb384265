"""Cell-level text rules of the statement format: numbers, dates, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.calendar import iso_date

KEY_SEP = "\u001f"
ORDINAL_SEP = "\u001e"
# Cells that mean "nothing here", and the shapes of dates and numbers.
BLANKS = ["", "--", "-"]
ISO_PREFIX = r"^(\d{4}-\d{2}-\d{2})(?:,?\s+(\d{2}:\d{2}:\d{2}))?"
NUMBER = r"^-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$"
CUSTODY = " - Held with"
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4,
    "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x) -> Column:
    """Number in a cell; blanks are NULL, thousands separators and a trailing % go."""
    t = F.trim(_c(x))
    plain = F.regexp_replace(F.regexp_replace(t, ",", ""), "%$", "").try_cast("double")
    ok = F.abs(plain) < F.lit(float("inf"))
    return F.when(~t.isin(*BLANKS) & ok, plain)


def num0(x) -> Column:
    return F.coalesce(num(x), F.lit(0.0))


def to_date(x) -> Column:
    return iso_date(F.regexp_extract(F.trim(_c(x)), ISO_PREFIX, 1))


def to_datetime(x) -> Column:
    """Exchange-local date and time; a missing time is midnight."""
    t = F.trim(_c(x))
    day, clock = F.regexp_extract(t, ISO_PREFIX, 1), F.regexp_extract(t, ISO_PREFIX, 2)
    text = F.concat(day, F.lit(" "), F.when(clock == "", "00:00:00").otherwise(clock))
    return F.when(day != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def plain_cell(x) -> Column:
    """A cell without outer blanks, any run of white space as one blank."""
    return F.regexp_replace(F.trim(F.coalesce(_c(x), F.lit(""))), r"\s+", " ")


def canon_plain(t: Column) -> Column:
    """`canon` of a cell that went through `plain_cell`; give a column or lambda variable, it is read many times."""
    clock = F.regexp_extract(t, ISO_PREFIX + "$", 2)
    fixed = F.format_string("%.9f", F.regexp_replace(t, ",", "").try_cast("double"))
    number = F.regexp_replace(F.regexp_replace(fixed, r"\.?0+$", ""), "^-0$", "0")
    return (
        F.when(t.isin(*BLANKS), "")
        .when(t.rlike(ISO_PREFIX + "$"), F.concat(F.regexp_extract(t, ISO_PREFIX + "$", 1), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise("")))
        .when(t.rlike(NUMBER), number).otherwise(t)
    )


def canon(x) -> Column:
    """Comparable form of a cell: blanks, datetimes and numbers are normalised."""
    return canon_plain(plain_cell(x))


def split_codes(x) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), ";"), lambda c: F.trim(c))
    return F.filter(parts, lambda c: c != "")


def canon_codes(x) -> Column:
    """The code set in sorted order."""
    return F.array_join(F.array_sort(split_codes(x)), ";")


def asset_bucket(x) -> Column:
    """Asset category without its custody suffix."""
    return F.trim(F.substring_index(F.coalesce(_c(x), F.lit("")), CUSTODY, 1))


def content_id(key: Column, ordinal: Column) -> Column:
    """Stable id of a row: hash of its natural key and occurrence number."""
    return F.substring(F.sha2(F.concat(key, F.lit(ORDINAL_SEP), ordinal.cast("string")), 256), 1, 20)


def _ymd(y, m, d) -> Column:
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _span(token: Column) -> tuple[Column, Column]:
    """First and last day that a period endpoint denotes, NULL when ambiguous."""
    t = F.trim(token)
    months = F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv])
    i = lambda pattern, g: F.regexp_extract(t, pattern, g).try_cast("int")
    month = lambda pattern, g: months[F.lower(F.regexp_extract(t, pattern, g))]
    year, iso = r"^(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    named = r"^([A-Za-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$"
    monthly, short = r"^([A-Za-z]+)\.?\s+(\d{4})$", r"^(\d{1,2})-([A-Za-z]{3,})-(\d{2}|\d{4})$"
    y2 = i(short, 3)
    day = (
        F.when(t.rlike(iso), _ymd(i(iso, 1), i(iso, 2), i(iso, 3)))
        .when(t.rlike(named), _ymd(i(named, 3), month(named, 1), i(named, 2)))
        .when(t.rlike(short), _ymd(F.when(y2 < 100, y2 + 2000).otherwise(y2), month(short, 2), i(short, 1)))
    )
    first = _ymd(i(monthly, 2), month(monthly, 1), F.lit(1))
    start = F.when(t.rlike(year), _ymd(i(year, 1), F.lit(1), F.lit(1))).when(t.rlike(monthly), first).otherwise(day)
    end = F.when(t.rlike(year), _ymd(i(year, 1), F.lit(12), F.lit(31))).when(t.rlike(monthly), F.last_day(first)).otherwise(day)
    return start, end


def period(x) -> Column:
    """struct(start, end) of a period text such as `January 1, 2025 - March 31, 2025`."""

    def span(token: Column) -> Column:
        start, end = _span(token)
        return F.struct(start.alias("start"), end.alias("end"))

    def both(spans: Column) -> Column:
        start, end = F.get(spans, F.lit(0))["start"], F.get(spans, F.lit(1))["end"]
        return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))

    # arrays of one or two, so that a variable of a lambda stands for each long expression
    parts = F.transform(F.array(F.split(F.trim(_c(x)), "\\s+[-\u2013\u2014]\\s+")), lambda p: F.array(F.element_at(p, 1), F.element_at(p, -1)))
    spans = F.transform(parts, lambda p: F.transform(p, span))
    return F.get(F.transform(spans, both), F.lit(0))
